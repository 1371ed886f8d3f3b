"""Every text operator against a plain version, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import textwrap
import tracemalloc
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytomosaic.llm import chat, common, components, decontaminate, langid, licences, lm, mixing, repeats, sharding, simhash, topk
from cytomosaic.session import cut

# columns that no operator may stumble over
CLASH = ["fp", "hits", "size", "place", "row", "h", "n", "kept", "shard", "slot", "copies", "_row", "block", "score", "spans", "component_id", "position"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def sample():
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), None, "", "   \t\n", "one", "one two", "?!", words(rng, 9) + " " + passage,
             passage + " " + words(rng, 30), words(rng, 15) + "\n" + passage + "\n" + words(rng, 5), "ab " * 400, "x" * 900, "y" * 199, "é" * 300,
             words(rng, 4000), "Ünïcode Wörter " * 40, words(rng, 3) + "\x0b" + words(rng, 3)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, words(rng, rng.randint(1, 60)), "en", "s0") for i in range(30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, rows without id and rows without anything."""
    return frame(spark, [*rows, *rows[:4], (None, rows[0][1], None, None), (None, "nobody else says this", None, None), (None, None, None, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_simhash_matches_all_pairs(docs, odd, empty, rows):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == sorted(brute.simhash(pairs(rows)))
    want = brute.simhash([(r.doc_id, r.text) for r in odd.collect()])
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(odd, empty, docs, rows):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    groups = {c for _, _, c in brute.simhash(pairs(rows))}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups) and ids.count(None) == 1
    assert simhash.one_per_group(empty).count() == 0


def test_rows_that_share_an_id_but_no_group_stay_apart(spark):
    a, b = words(random.Random(1), 50), words(random.Random(2), 50)
    near = " ".join([*a.split()[:-1], "other"])
    table = [(5, a), (5, a), (5, b), (9, b), (5, near), (None, a), (None, "alone here"), (None, "alone here")]
    fp = {t: simhash.fingerprint(t.encode()) for t in (a, b, near)}
    groups = 2 if (fp[a] ^ fp[near]).bit_count() <= simhash.RADIUS else 3
    kept = [tuple(r) for r in simhash.one_per_group(spark.createDataFrame(table, "doc_id long, text string")).collect()]
    assert kept.count((None, "alone here")) == 1 and kept.count((5, b)) == 1 and len(kept) == groups + 1 and (9, b) not in kept and (None, a) not in kept


def test_starts_of_ranges_over_two_levels(spark, monkeypatch):
    monkeypatch.setattr(common, "SPAN", 3)
    table = [(k, r, (7 * r + len(k or "")) % 5) for k in ("a", "bb", None) for r in (0, 1, 2, 3, 5, 8, 9, 20)]
    got = common.range_starts(spark.createDataFrame(table, "k string, r long, n long"), ["k"], "r", "n").collect()
    assert len(got) == len(table)
    assert all(g._start == sum(n for k, r, n in table if k == g.k and r < g.r) for g in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_pigeonring_loses_no_link(spark, seed):
    """Random fingerprints around a few centres, among them one dense crowd that shares buckets."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    crowd = [int(c) for c in centres]
    for c in centres[:2]:
        for _ in range(220):
            crowd.append(int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 9, 4))))
    for c in centres[2:]:
        for _ in range(12):
            crowd.append(int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 6)))))
    marks = sorted(set(crowd))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = simhash.link_edges(spark.createDataFrame([(m,) for m in signed], "fp long"))
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.distinct().collect())
    got = {r.node: r.component for r in components.components(edges).collect()}
    parent = {m: m for m in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {m: got.get(m, m) for m in signed} == {m: root(m) for m in signed}


def test_components_of_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 202), (202, 201)]
    got = dict(tuples(components.components(spark.createDataFrame(links, "a long, b long").repartition(7)), "node", "component"))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(3)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("fits", [components.FITS, 500, 0])
def test_components_of_few_edges_take_few_stages(spark, monkeypatch, fits):
    stages, path = [], [(i, i + 1) for i in range(0, 3000) if i % 1000 != 999]
    monkeypatch.setattr(components, "FITS", fits)
    monkeypatch.setattr(components, "cut", lambda df: stages.append(cut(df)) or stages[-1])
    links = spark.createDataFrame(random.Random(3).sample(path, len(path)), "a long, b long").repartition(16)
    got = dict(tuples(components.components(links), "node", "component"))
    assert got == {i: i // 1000 * 1000 for i in range(3000)}
    if fits == components.FITS and fits > 500:
        assert len(stages) == 2


def test_repeats_match_brute_force(docs, odd, empty, rows):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans")
    for df in (docs, odd):
        got = repeats.remove_repeats(df)
        assert set(got.columns) == set(df.columns) | {"n_bytes", "n_removed", "n_spans", "kept"}
        mine = sorted(((*(r[c] for c in cols), brute.sha(bytes(r.kept))) for r in got.collect()), key=str)
        assert mine == sorted(brute.repeats([(r.doc_id, r.text) for r in df.collect()]), key=str)
    assert repeats.remove_repeats(empty).count() == 0


def test_crowded_anchors_meet_window_by_window(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 2)
    got = repeats.remove_repeats(docs)
    assert tuples(got, "doc_id", "n_removed") == sorted(((d, n) for d, _, n, *_ in brute.repeats(pairs(rows))), key=str)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    a, b = words(rng, 900), words(rng, 200)
    table = [(0, a + b + a[:700]), (1, words(rng, 50) + b)]
    monkeypatch.setattr(repeats, "_PIECE", 512)
    got = repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string"))
    assert tuples(got, "doc_id", "n_removed", "n_spans") == [(d, n, s) for d, _, n, s, _ in brute.repeats(table)]


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item"), (10, "a, b; c"), (3, None), (4, " - "), (None, "lonely phrase"),
         (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (2, "Short item")]
TEXTS = ["x ALPHA-beta gamma\ndelta epsilon zeta eta theta iota kappa lambda mu and beta", "beta gamma delta epsilon zeta eta theta iota kappa", "a short, item: a b c d",
         None, "", "...", "short item short item", "beta gamma delta epsilon zeta eta theta iota kappa lambda nu mu", "the lonely phrase", "été short", "short" + " x" * 3000 + " item short item"]


def test_suffix_automaton_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, words string")
    found = decontaminate.match(docs, items)
    got = [(r.doc_id, r.hits.n_words, r.n, len(r.hits.items), brute.sha(",".join(r.hits.items).encode())) for r in found.withColumn("n", decontaminate.n_hit()).collect()]
    named = [i for i in ITEMS if i[0] is not None]
    want = [w[:5] for w in brute.contaminated(list(enumerate(TEXTS)), named)]
    hits = {d: n for d, _, n, *_ in brute.contaminated(list(enumerate(TEXTS)), ITEMS)}
    assert sorted(got) == [(d, n, hits[d], k, s) for d, n, _, k, s in want]
    assert decontaminate.match(docs.limit(0), items).count() == 0
    clean = decontaminate.match(docs, items.limit(0)).collect()
    assert all(not r.hits.runs and not r.hits.items for r in clean)


def test_many_automata_give_the_same_hits(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = tuples(decontaminate.match(docs, items), "doc_id", "hits")
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 5)
    assert tuples(decontaminate.match(docs, items), "doc_id", "hits") == one


def test_random_words_through_the_automaton():
    rng = random.Random(11)
    for _ in range(60):
        items = [(i, words(rng, rng.randint(0, 16), "ab")) for i in range(5)]
        texts = list(enumerate(words(rng, rng.randint(0, 80), "ab") for _ in range(4)))
        machine = decontaminate.SuffixAutomaton([(str(i), decontaminate.words_of(t.encode())) for i, t in items], 4)
        for (doc_id, text), want in zip(texts, brute.contaminated(texts, items, 4)):
            n, runs, hit = machine.scan(text.encode())
            assert (doc_id, n, sum(b - a for a, b in runs), len(hit)) == want[:4]


def test_spans_are_cut_out_and_covered_documents_go(spark):
    text = "keep this. Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu! and this stays as well, all of it, to the end of the text"
    table = [(1, text, 5), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 5), (3, "clean", 5), (4, None, 5), (5, "", 5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_chars long")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == "keep this. ! and this stays as well, all of it, to the end of the text" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "clean" and got[3].n_chars == 5 and got[4].text is None


def test_mix_follows_the_queues(docs, odd, empty, rows):
    slim = cut(mixing.sized(docs))
    decided = mixing.decide(slim, cut(mixing.schedule(slim))).collect()
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert {r.doc_id: r.copies for r in decided if r.size} == {d: want[d] for d, t, *_ in rows if brute.space_words(t)}
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(brute.space_words(t))
    targets = brute.mix_targets(sizes)
    assert all(abs(r.target - targets[r.source]) < 1e-6 for r in decided)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    assert {d: n for d, n in taken.items() if brute.space_words(rows_text(rows, d))} == {d: n for d, n in want.items() if n and brute.space_words(rows_text(rows, d))}
    mixing.mix(odd).collect()
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.filter("text is null or trim(text) = ''")).count() >= 0


def rows_text(rows, doc_id):
    return next(t for d, t, *_ in rows if d == doc_id)


def test_queues_in_many_ranges(docs, rows, monkeypatch):
    slim = cut(mixing.sized(docs))
    whole = tuples(mixing.decide(slim, cut(mixing.schedule(slim))), "doc_id", "copies")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert tuples(mixing.decide(slim, cut(mixing.schedule(slim))), "doc_id", "copies") == whole


def test_groups_of_copies_are_cut_by_count(spark, monkeypatch):
    """600 equal rows without id, and 300 with one id, among others: every source meets its target to one document."""
    word = "w " * 4
    made = [(None, word, "a")] * 600 + [(i, word, "a") for i in range(100)]
    made += [(7000, word, "b")] * 300 + [(1000 + i, word, "b") for i in range(400)] + [(3000 + i, word, "c") for i in range(700)]
    made += [(None, None, "d")] * 40 + [(9000, "", "d")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    slim = cut(mixing.sized(docs))
    plan = cut(mixing.schedule(slim))
    decided = mixing.decide(slim, plan).collect()
    assert len(decided) == len(made)
    taken, target = Counter(), {}
    for r in decided:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in "abcd")
    assert sum(taken.values()) <= 1.5 * 4 * 2100
    assert all(r.copies == 1 for r in decided if r.source == "d")
    want = sorted((str(r.doc_id), r.source, r.copies) for r in decided)
    mixed = Counter((str(r.doc_id), r.source) for r in mixing.mix(docs).collect())
    total = Counter()
    for d, s, n in want:
        total[d, s] += n
    assert mixed == total
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "UNFOLD", 7)
    assert sorted((str(r.doc_id), r.source, r.copies) for r in mixing.decide(slim, cut(mixing.schedule(slim))).collect()) == want


def test_shards_are_gapless_and_keep_every_row(odd, empty, monkeypatch):
    for bucket in (8 << 20, 300):
        got = sharding.shards(odd, 5, bucket_bytes=bucket)
        assert set(got.columns) == set(odd.columns)
        rows = got.collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    again = tuples(sharding.shards(odd.dropDuplicates(["doc_id"]), 5), "doc_id", "shard", "slot")
    assert again == tuples(sharding.shards(odd.dropDuplicates(["doc_id"]), 5), "doc_id", "shard", "slot")
    assert sharding.shards(empty, 5).count() == 0


def test_equal_ids_do_not_fill_one_bucket(spark):
    rows = spark.range(0, 6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("word " * 20).alias("text"))
    got = sharding.shuffled(rows, bucket_bytes=20_000)
    assert got.count() == 6000 and got.agg(F.countDistinct("position")).first()[0] == 6000


def test_shards_are_written_in_slot_order(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    table = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(260)]
    table += [(300, table[1][1]), (301, table[1][1]), (350, [float("nan")] * 64), (400, None), (450, []), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, table[3][1]),
              (550, [None] * 64), (600, [float("inf")] * 64), (302, table[1][1])]
    df = spark.createDataFrame([(*r, "clash") for r in table], "vec_id long, embedding array<double>, vec string")
    got = topk.top_k(topk.vectors(df), F.col("vec_id") % 50 == 0)
    want = brute.top_k(table)
    assert tuples(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert topk.top_k(topk.vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_small_blocks_and_beyond_double_integers(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e6):
        table = [(i, [float(x) for x in rng.normal(0, scale, 16)]) for i in range(0, 400, 2)]
        got = topk.top_k(topk.vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0)
        assert tuples(got, "query_id", "rank", "vec_id", "score") == sorted(brute.top_k(table), key=str)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, v = rng.normal(0, 1, (5, 50)), rng.normal(0, 1, (40, 50))
    exact, last = q @ v.T, None
    for level in topk.LEVELS:
        (qm, qn), (vm, vn) = topk.statistics(q, level), topk.statistics(v, level)
        bound = qm @ vm.T + qn @ vn.T
        assert (bound >= exact - 1e-9).all()
        last = bound if last is None else last
    assert (bound <= last + 1e-9).mean() > 0.9


CHATS = [(1, 0, "user", "hi"), (1, 1, "bot", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "hello"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "bot", "hello"),
         (4, 1, "bot", "hello"), (5, 0, "user", None), (6, 0, None, "hi"), (7, 3, "user", "hi"), (7, 9, "bot", "no"), (8, None, "user", "hi"), (None, 0, "user", "hi"), (9, 0, "user", ""),
         (10, 0, "user", "twin"), (11, 0, "user", "twin"), (12, 0, "user", "tie"), (12, 0, "user", "tie2"), (13, 0, None, None)]


def test_maximal_chats(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "clash") for r in CHATS], "conv_id long, turn long, role string, text string, length string")
    whole = {r.conv_id: r.rendered for r in chat.format_chats(df).collect()}
    assert whole == brute.chats(CHATS)
    long = [(c, t, "user", f"turn {t}") for c, n in ((1, 30), (2, 17), (3, 29)) for t in range(n)] + [(3, 29, "user", "other end")]
    monkeypatch.setattr(chat, "SEGMENT", 4)
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    parts = defaultdict(list)
    for r in chat.format_chats(df, 4).collect():
        parts[r.conv_id].append((r.segment, r.rendered))
    assert {c: "".join(x for _, x in sorted(p)) for c, p in parts.items()} == brute.chats(long)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_licence_rules(spark):
    s = licences.SENTENCES
    mit = ". ".join(s[k].capitalize() for k in ("MITgrant", "MITnotice", "ASIS", "MITliable"))
    table = [(1, "Text.\nReleased under the MIT License.\n"), (2, mit + "."), (3, "Licensed under the Apache License, Version 2.0. " + s["ApacheMayNot"] + ". " + s["ApacheCopy"] + "."),
             (4, None), (5, ""), (6, "no licence here"), (7, s["ASIS"] + "."), (8, "Licensed under CC BY-NC 4.0! Licensed under CC BY-NC 4.0?\nnothing\nAll rights reserved."),
             (1, "Text.\nReleased under the MIT License.\n"), (None, "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(*r, "clash") for r in table], "doc_id long, text string, sid string")
    assert tuples(licences.scan(df), "doc_id", "licence", "n") == sorted([
        (1, "MIT", 1), (2, "MIT", 1), (3, "Apache-2.0", 2), (7, "unmatched:ASIS", 1), (8, "CC-BY-NC-4.0", 2), (8, "LicenseRef-All-Rights-Reserved", 1), (None, "GPL-3.0", 1)], key=str)
    assert licences.scan(df.limit(0)).count() == 0


def test_wrapped_and_commented_licence_texts(spark):
    s = licences.SENTENCES
    mit = "\n\n".join("\n".join(textwrap.wrap(s[k].capitalize() + ".", 60)) for k in ("MITgrant", "MITnotice", "ASIS", "MITliable"))
    header = "\n".join(f" * {line}" for k in ("GPLfree3+", "GPLhope") for line in [*textwrap.wrap(s[k] + ".", 50), ""]) + "\n * " + s["GPLdetails"] + "."
    spaced = (" " * 2000).join(s["MPLsubject"].split())
    df = spark.createDataFrame([(1, "Copyright someone\n\n" + mit), (2, "/*\n *\n" + header + "\n */\nint x;"), (3, spaced)], "doc_id long, text string")
    assert tuples(licences.scan(df), "doc_id", "licence", "n") == [(1, "MIT", 1), (2, "GPL-3.0-or-later", 1), (3, "MPL-2.0", 1)]


def _backoff_rows(rows):
    return sorted(((d, n, round(s, 4), b) for d, n, s, b in rows), key=str)


def test_backoff_matches_brute_force(docs, odd, empty, monkeypatch):
    for df in (docs, odd):
        want = _backoff_rows(brute.backoff([(r.doc_id, r.text) for r in df.collect()]))
        read = lambda df=df: _backoff_rows((r.doc_id, r.n_words, r.log_score, r.n_backoff) for r in lm.score(df).collect())
        assert read() == want
        with monkeypatch.context() as m:  # many blocks, most of them cut, and many buckets
            m.setattr(lm, "BLOCK_IDS", 8)
            m.setattr(lm, "BLOCK_BYTES", 900)
            m.setattr(lm, "BUCKET_BYTES", 4000)
            assert read() == want
    assert lm.score(empty).count() == 0


def test_backoff_tells_shuffled_words_and_copies_apart(spark):
    rng = random.Random(3)
    vocabulary = words(rng, 30).split()
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def fluent(n=80):
        said = [rng.choice(vocabulary)]
        while len(said) < n:
            said.append(rng.choice(after[said[-1]]))
        return said

    texts = [fluent() for _ in range(60)]
    mixed = rng.sample(texts[0], len(texts[0]))
    strange = words(rng, 80, "zqxj")
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, " ".join(mixed)), (101, strange), (102, strange.upper()), (103, words(rng, 80, "vwyu"))]
    mean = {r.doc_id: r.log_score / r.n_words for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(mean[i] for i in range(60)) > mean[100]  # fluent texts above their words shuffled
    assert mean[101] == mean[102] > mean[103] + 3  # a text said twice far above one said once


def test_block_and_bucket_hold_few_bytes_per_ngram():
    """Peaks of numpy's arrays while a block is scored and a bucket summed, for every n-gram that they hold."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50_000) for _ in range(400)]
    grams = [g for t in texts for g in lm.gram_hashes(lm.word_hashes(t))]
    occurrences, (gram, n) = sum(map(len, grams)), lm._counted(list(grams))
    more = rng.integers(1, 9, len(gram)).astype(np.int32)
    rows = [(0, b, len(gram), lm._packed(np.diff(gram, prepend=np.uint64(0))), lm._packed(n)) for b in range(8)]
    runs = pa.table([pa.array(c) for c in zip(*rows)], ["bucket", "block", "size", "steps", "n"])
    peaks = []
    for run in (lambda: lm.score_texts(iter(texts), np.ones(len(texts), np.int64), more, 10**7), lambda: lm.sum_bucket(runs)):
        tracemalloc.start()
        out = run()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert np.array_equal(lm._unpacked(out["more"][3].as_py(), len(gram)).astype(np.int64), 7 * n)
    assert peaks[0] < 26 * occurrences and peaks[1] < 30 * 8 * len(gram), (peaks[0] / occurrences, peaks[1] / len(gram) / 8)


def test_word_hashes_see_whole_words_only():
    long = "a" * (1 << 20) + " b\x0bB\u00a0b\tc " + "x" * 3000
    got = lm.word_hashes(long)
    want = long.encode().lower().split()
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    assert lm.word_hashes(" \t\n").size == lm.word_hashes(None).size == lm.word_hashes("").size == 0


def languages(n=40):
    rng = random.Random(8)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "éèçàü"}
    return [(i, words(rng, rng.randint(3, 80), kinds[k]), k, "s") for i, k in enumerate(rng.choice(list(kinds)) for _ in range(n * 3))]


def test_ppm_code_lengths_are_exact():
    """Costs of the frozen trees equal a plain walk down the orders, and sum up over pieces."""
    import math

    rng = random.Random(1)
    train = {"x": [words(rng, 30, "ab") for _ in range(4)], "y": [words(rng, 30, "bc") for _ in range(4)]}
    langs, grams, n = [], [], []
    counts = {k: [defaultdict(Counter) for _ in range(langid.ORDER + 1)] for k in train}
    for at, (k, texts) in enumerate(train.items()):
        for t in texts:
            raw = b" " * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(raw)):
                langs.append(at)
                grams.append(int.from_bytes(raw[i - langid.ORDER:i + 1], "big"))
                n.append(1.0)
                for o in range(langid.ORDER + 1):
                    counts[k][o][raw[i - o:i]][raw[i]] += 1
    model = langid.Contexts(["x", "y"], np.array(langs), np.array(grams), np.array(n))
    texts = ["abab ba", "cab zebra", "q"]
    want = []
    for t in texts:
        raw, bits = b" " * langid.ORDER + t.encode(), []
        for k in train:
            total = 0.0
            for i in range(langid.ORDER, len(raw)):
                for o in range(langid.ORDER, -1, -1):
                    seen = counts[k][o].get(raw[i - o:i])
                    if seen and raw[i] in seen:
                        total += math.log2((seen.total() + len(seen)) / seen[raw[i]])
                        break
                    if seen:
                        total += math.log2((seen.total() + len(seen)) / len(seen))
                else:
                    total += 8
            bits.append(total)
        want.append(bits)
    for size in (3, 1 << 20):
        assert np.allclose(model.code_lengths([t.encode() for t in texts], size), want, rtol=1e-4)


def test_language_of_held_out_documents(spark, empty):
    table = [*languages(), (900, None, "aa", "s"), (901, "123 ...", "aa", "s"), (902, "", None, "s"), (903, "abcab dedc abc", None, None), (None, "abcab dedc abc", "bb", None)]
    df = frame(spark, table)
    fold = langid.held_out(F.col("doc_id"))
    model = langid.train(df.filter(~fold & F.col("doc_id").isNotNull()))
    got = langid.identify(df.withColumn("held", fold), model)
    out = {r.doc_id: r for r in got.collect()}
    tested = [out[i].lang_pred == k for i, _, k, _ in languages() if out[i].held]
    assert len(tested) > 15 and np.mean(tested) > 0.95
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].score == 0
    assert set(df.columns) <= set(got.columns)
    assert langid.train(empty) is None
    nameless = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("doc_id", F.lit(None).cast("long"))
    few, every = (langid.train(nameless, n).symbols[-1][0] for n in (10, 1000))
    assert 0 < len(few) < len(every)
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    kept = langid.in_known_language(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.filter("score <> 'clash'").count() == 0
