import duckdb

from medialake.llm import licenses, queries
from pyspark.sql import functions as F
from tests.llm.cases import awkward, empty

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.py", "plain words"),
    (3, "a/b/c/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (4, "a/b/c/d/y.py", None),
    (5, "a/b/c/d/z.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore"),
    (6, "ab/w.py", "the name of its folder only begins like that of a licensed one"),
    (7, None, "no path"),
    (8, "top.py", ""),
]


def test_inheritance(spark):
    rows = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan(spark.createDataFrame(FILES, "doc_id long, path string, text string")).collect()}
    assert rows == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "a/b/c"), 5: ("Apache-2.0", "own", None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None)}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    key = lambda rows: sorted((r[0], r[1], r[2], r[3] and round(r[3], 8), r[4], r[5]) for r in rows)
    names = "doc_id, path, license, cosine, origin, license_dir"
    assert key(con.execute(f"select {names} from ({queries.ORACLE_SQL['op7_licenses']})").fetchall()) == key(map(tuple, queries.op7_licenses(spark, sf).select(*names.split(", ")).collect()))


def test_cases(spark):
    docs = awkward(spark).withColumns({"path": F.concat(F.lit("p/"), "doc_id"), "license": F.lit("clash")})
    assert licenses.scan(docs).count() == 11
    assert licenses.scan(empty(spark).withColumn("path", F.lit("x"))).count() == 0


def test_wrapped_headers(spark):
    mit = "# Copyright (c) 2020 Someone. Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and associated documentation files (the\n# \"Software\"), to deal in the Software without restriction, including without\n# limitation the rights to use"
    gpl = " * This program is free software: you can redistribute it and/or modify\r\n * it under the terms of the GNU General Public License as published by\r\n *\r\n * the Free Software Foundation, either version 3 of the License, or\r\n * (at your option) any later version."
    bsd = "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions\n// are met"
    far = "free software\n" + "other words stand here\n" * 40 + "GNU General Public License"
    code = "\nx = call(y)\n" * 30
    rows = [(1, "a/x.py", code + mit + code), (2, "b/y.c", code + gpl), (3, "c/z.go", bsd + code), (4, "d/w.py", far), (5, None, bsd), (6, None, "Released under the MIT License."), (7, None, "none")]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("GPL-3.0", "own"), 3: ("BSD-3-Clause", "own"), 4: (None, None), 5: ("BSD-3-Clause", "own"), 6: ("MIT", "own"), 7: (None, None)}


HEADERS = {
    "MIT": "Copyright (c) 2021 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
    "BSD-3-Clause": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def test_headers_in_comments_and_plain_prose(spark):
    rows, code = [], "\n\nimport numbers\n\ndef add(one, two):\n    return one + two\n"
    for name, text in HEADERS.items():
        for k, mark in enumerate(("", "# ", "// ", " * ")):
            rows.append((f"{name}/{k}", f"{name}/{k}/x", "\n".join(mark + line for line in text.split("\n")) + code))
    prose = ["In the end all rights were reserved", "The license was lost, and nobody could say who had published it.", "Permission is a fine thing, but this person had none to give.", "words and more words\n" * 50]
    rows += [(f"prose/{i}", f"p{i}/x", t) for i, t in enumerate(prose)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, path string, text string")).collect()}
    wrong = {k: v for k, v in got.items() if v != (None if k.startswith("prose") else k.split("/")[0])}
    assert not wrong, wrong


def test_pattern_of_anchors():
    import re

    found = ["a", "any", "and", "license", "licenses", "b2"]
    pattern = re.compile(licenses.any_of(found))
    assert all(pattern.fullmatch(w) for w in found) and not any(pattern.fullmatch(w) for w in ("an", "licen", "b", "", "anyone"))
    assert not re.search(licenses.any_of([]), "anything")


def test_runs_equal_all_pairs_of_lines(spark):
    vectors = licenses.template_vectors([("a", "p q r s"), ("b", "u v")], dict.fromkeys("pqrsuv", 1.0))
    text = "x p\n\nq\nr s x\nx x\nu\nx u\n--\nv p q\nr\ns x x x x x x\nq r s\nx x x\np"
    lines = [x.split() for x in text.split("\n") if x.strip("-")]
    marks = set(licenses.anchors(vectors, 0.75))
    want = []
    for i in range(len(lines)):
        for j in range(i + 2, len(lines) + 1):
            held = set(sum(lines[i:j], []))
            if held & marks and any(sum(v[w] ** 2 for w in held & set(v)) >= 0.5624 and len(sum(lines[i:j], [])) <= 1.5 * n for n, (_, v) in zip((4, 2), vectors)):
                want.append(" ".join(map(" ".join, lines[i:j])))
    single = [" ".join(x) for x in lines if set(x) & marks]
    mark = F.lit("(^|[^a-z0-9])(" + "|".join(marks) + ")($|[^a-z0-9])")
    docs = spark.createDataFrame([(1, text), (2, "x p x"), (3, ""), (4, "--\n")], "i int, t string")
    whole = F.when(F.col("i") == 2, F.array("t")).otherwise(F.array().cast("array<string>"))
    got = licenses.units(docs, "t", whole, mark, vectors, [4, 2], 0.75).collect()
    assert want and sorted(r._line for r in got if r.i == 1) == sorted(want + single)
    assert [r._line for r in got if r.i > 1] == ["x p x", "x p x"]


STATEMENTS = [
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GPLv2."),
    ("GPL-3.0", "# Licensed under the GPLv3"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-SA-3.0", "Licensed under CC BY-NC-SA 3.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("Proprietary", "Copyright 2019 Foo Inc. All rights reserved."),
    ("Proprietary", "# (c) 2001-2020 The Quite Long Name of Some Company, Limited, of Somewhere. All Rights Reserved."),
    ("MIT", "Copyright (c) 2020 Foo. All rights reserved.\nReleased under the MIT License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("EPL-2.0", " * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999"),
]
PROSE = [
    "The license of the house was granted in the spring.", "Nobody may copy this by hand, said the clerk, and all rights were lost.", "The public license office opens at two.", "A general of the public library spoke for an hour.",
    "Version 2 of the story is longer than version 3.", "She released the bird under the old license of the town.", "Redistribution of land was on the list of conditions.", "The software was free, but the font was not.",
    "He copied, modified and merged three drafts into one.", "Permission was granted, free of charge, to any visitor.", "The foundation gave away its source of income.", "In no event was the warranty used.",
    "The apache helicopter, version 2, flew over the gnu.", "Creative people share alike.", "Copyright is a word in this sentence and nothing more.", "An identifier of the license plate was read aloud.",
    "The mozilla in the poem was a lizard.", "The work is in the public domain of talk.", "By 4.0 seconds she won the race.", "All rights reserved seats were taken by the guests of the museum on that day.",
]


def test_versions_variants_tags_and_notices(spark):
    code = "\n\nimport numbers\n\ndef add(one, two):\n    return one + two\n"
    rows = [(i, f"{i}/x", text + code) for i, (_, text) in enumerate(STATEMENTS)]
    rows += [(1000 + i, f"{1000 + i}/x", f"Some words came before.\n{text}\nAnd others after.") for i, text in enumerate(PROSE)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, path string, text string")).collect()}
    wrong = [(name, got[i], text) for i, (name, text) in enumerate(STATEMENTS) if got[i] != name]
    wrong += [(None, got[1000 + i], text) for i, text in enumerate(PROSE) if got[1000 + i]]
    assert not wrong, wrong
