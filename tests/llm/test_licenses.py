"""License scans of real licence texts, none of which is in the test tables."""

from memloom.llm import license_scan

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
APACHE = """// Copyright 2021 The Example Authors. All Rights Reserved.
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
package main
func main() { fmt.Println("hello", world, other, things) }
"""
GPL = """#!/usr/bin/python
# frobnicate - turn things around
#
# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version {} of the License, or
# (at your option) any later version.
import os, sys, json, random
"""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
PROSE = "The weather was fine and we walked along the river.\nNobody had permission to copy the notice of conditions.\nWarranty and software were far from our minds."


def test_real_licenses(spark):
    want = {
        "MIT License": "MIT", "The MIT License (MIT)": "MIT", "GNU GENERAL PUBLIC LICENSE": "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991": "GPL-2.0",
        "Apache License": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0", "x = 1\n// SPDX-License-Identifier: MIT\ny": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "Copyright (c) 2020 Foo. All rights reserved.": "Proprietary", "Copyright (c) 2018 Jane Roe\n\n" + GRANT: "MIT",
        "Copyright (c) 2018 Jane Roe. All rights reserved.\n\n" + GRANT: "MIT", "Third parties\n\n" + PROSE + "\n\n" + GRANT + "\n" + PROSE: "MIT", APACHE: "Apache-2.0", GPL.format(2): "GPL-2.0", GPL.format(3): "GPL-3.0",
        "Copyright (c) 2011, Foo Inc.\nAll rights reserved.\n\n" + BSD2: "BSD-2-Clause", "Copyright (c) 2011, Foo Inc.\nAll rights reserved.\n\n" + BSD2.replace("\n\nTHIS", "\n" + NEITHER + "\n\nTHIS"): "BSD-3-Clause",
        "Copyright (c) 2011, Foo Inc.": None, "er kommt\nmit\nihr": None, PROSE: None, "SPDX-License-Identifier: Foo-1.0": None, "": None,
    }
    files = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(want)], "path string, text string")
    got = {r["path"]: r["license"] for r in license_scan.scan(files).collect()}
    assert {t[:60]: got[f"d{i}/f"] for i, t in enumerate(want)} == {t[:60]: v for t, v in want.items()} and [got[f"d{i}/f"] for i in range(len(want))] == list(want.values())


def test_no_unit_is_lost_beforehand(spark):
    """The anchors' bound: without its anchors a template has no part that reaches the threshold."""
    held, limit = {}, license_scan.THRESHOLD
    for _, k, _, w, share, _ in license_scan.form_weights(license_scan.forms()):
        held.setdefault(k, {})[w] = share
    for shares in held.values():
        rest = [s for w, s in shares.items() if w not in license_scan.anchors(shares, limit)]
        assert sum(s * s for s in rest) ** 0.5 < limit or len(rest) < license_scan.least(len(shares), limit)
