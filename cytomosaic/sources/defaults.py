"""Default marker lists, rules, modules and gene groups. All of them can be replaced by the caller."""

from __future__ import annotations

# Gene names and thresholds that must equal the published study for equal results.

BROAD_MARKERS = {
    "Orexigenic neuron": ["Agrp", "Npy", "Ghsr"],
    "Anorexigenic neuron": ["Pomc", "Cartpt", "Mc3r"],
    "Dopaminergic neuron": ["Slc6a3", "Slc18a3"],
    "Peptidergic neuron": ["Sst", "Nts", "Cck", "Crh"],
    "GABAergic neuron": ["Slc32a1", "Gad1", "Gad2"],
    "Glutamatergic neuron": ["Slc17a7", "Adcyap1", "Bdnf"],
    "Hcrt/Orexin neuron": ["Hcrt"],
    "Neuroendocrine neuron": ["Oxt", "Avp"],
    "Tanycyte": ["Gpr50", "Mfsd2a", "Lef1", "Notch1"],
    "Astrocyte": ["Aqp4", "Gfap", "Ntsr2"],
    "Oligodendrocyte": ["Opalin", "Sox10", "Gjc3"],
    "OPC": ["Pdgfra", "Cspg4", "Gpr17"],
    "Microglia": ["Siglech", "Spi1", "Trem2", "Cd68"],
    "Endothelial": ["Cldn5", "Pecam1"],
    "Pericyte": ["Acta2", "Carmn"],
    "VLMC": ["Col1a1", "Dcn"],
}

THRESHOLD_RULES = [
    ("AgRP/NPY neuron", "Agrp", 0.5),
    ("POMC neuron", "Pomc", 0.5),
    ("Orexin neuron", "Hcrt", 0.3),
    ("Oxytocin neuron", "Oxt", 0.3),
    ("AVP neuron", "Avp", 0.3),
    ("Dopaminergic neuron", "Slc6a3", 0.3),
    ("Tanycyte", "Gpr50", 0.3),
    ("Microglia", "Siglech", 0.3),
    ("Microglia", "Cd68", 0.5),
    ("OPC", "Pdgfra", 0.5),
    ("Oligodendrocyte", "Opalin", 0.5),
    ("Oligodendrocyte", "Sox10", 0.5),
    ("Astrocyte", "Aqp4", 0.5),
    ("Astrocyte", "Gfap", 0.5),
    ("Endothelial", "Cldn5", 0.5),
    ("Pericyte", "Carmn", 0.3),
    ("VLMC", "Col1a1", 0.3),
    ("Inhibitory Neuron", "Gad1", 0.5),
    ("Inhibitory Neuron", "Gad2", 0.5),
    ("Excitatory Neuron", "Slc17a7", 0.5),
]

NEUROPEPTIDE_MODULES = {
    "AgRP/NPY (orexigenic)": ["Agrp", "Npy", "Npy1r", "Npy2r", "Npy5r", "Ghsr"],
    "POMC/CART (anorexigenic)": ["Pomc", "Cartpt", "Pcsk1", "Pcsk2", "Mc3r"],
    "KNDy (Kiss1/Tac2/Pdyn)": ["Kiss1", "Tac2", "Pdyn", "Tacr3", "Kiss1r"],
    "Somatostatin": ["Sst", "Sstr1", "Sstr2", "Sstr3", "Sstr4", "Sstr5"],
    "TRH/Dopamine": ["Trh", "Trhr", "Th", "Slc6a3", "Drd1", "Drd2"],
    "Galanin system": ["Gal", "Galr1", "Galr2", "Galr3"],
}

INSULIN_GROUPS = {
    "Insulin/IGF receptor & transport": ["Insr", "Igf1", "Igf2", "Igfbp4", "Igfbp5", "Igfbp6", "Slc2a1", "Slc2a2", "Gck"],
    "Energy-sensing receptors": ["Lepr", "Ghsr", "Glp1r", "Gipr", "Mc3r", "Gpr50", "Npy4r", "Cckar", "Crhr2", "Sstr5", "Galr1", "Galr3"],
    "Orexigenic neuropeptides": ["Npy", "Agrp", "Hcrt", "Pnoc", "Npvf", "Tac2", "Grp", "Nmb"],
    "Anorexigenic neuropeptides": ["Pomc", "Cartpt", "Adcyap1", "Sst", "Vip", "Nts", "Cck", "Gal", "Ucn3", "Oxt", "Avp", "Prlh", "Tac1", "Sct", "Ghrh"],
}
