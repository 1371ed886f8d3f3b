"""The licence scan on licence headers as they are published, unmodified."""

import textwrap

import pytest

from cytomosaic.llm import licences

GPL = '''one line to give the program's name and an idea of what it does.
Copyright (C) 2020  A. Author

{}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
GPL2 = GPL.format('''This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.''')
GPL3 = GPL.format('''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.''')
APACHE = '''Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
BSD2 = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD3 = BSD2 + '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
HEADERS = [(GPL2, "GPL-2.0-or-later"), (GPL3, "GPL-3.0-or-later"), (APACHE, "Apache-2.0"), (APACHE.replace("http:", "https:"), "Apache-2.0"),
           (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (MPL, "MPL-2.0")]


@pytest.mark.parametrize("lead", ["", "# ", " * "])
def test_published_headers(spark, lead):
    texts = [textwrap.indent(text, lead, lambda line: True) for text, _ in HEADERS]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licence, r.n) for r in got) == [(i, licence, 1) for i, (_, licence) in enumerate(HEADERS)]
