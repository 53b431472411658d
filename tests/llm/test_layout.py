from seekspark.llm import layout

HAND = "// Copyright 2024 A. All rights reserved.\nimport a from 'b';\n\nexport function go(x) {\n  const y = x + 1;\n  // careful\n  return y;\n}\n"
MINIFIED = "!function(e,t){" + "".join(f"var a{i}=t(e);if(a{i}){{e.x=a{i};}}" for i in range(60)) + "}(this);"


def test_kinds(spark):
    blob = "export const A = [\n" + '  "FYhC87BQ+EHMkGjlcFNJgiVjaegacy8uG8wZ75hgWNdA",\n' * 30 + "];\n"
    prose = "export const A = [\n" + '  "a sentence of some words that people wrote",\n' * 30 + "];\n"
    files = {
        1: ("r/src/a.ts", [HAND]), 2: ("r/src/b.ts", [MINIFIED]), 3: ("r/src/c.ts", [blob]), 4: ("r/src/d.ts", [prose]), 5: ("r/vendor/x/a.py", [HAND]), 6: ("r/src/vendors/a.ts", [HAND]),
        7: ("r/package-lock.json", ["{}"]), 8: ("r/src/e.ts", ["// Code generated by tool. DO NOT EDIT.\n" + HAND]), 9: ("r/src/f.ts", ["// do not edit the row while a plan is open\n" + HAND]),
        10: ("r/src/g.py", ["# fastlib v1.2.3\n# (c) the fastlib contributors, released under the MIT licence\nimport x\n"]), 11: ("r/gen/k.rs", []), 12: ("r/src/l.rs", []), 13: ("r/src/m.json", [blob]),
        14: ("r/src/n.py", [f"def get{c}(self):\n    return self._f[{i}]\n" for i, c in enumerate("ABCDE")]), 15: ("r/src/o.ts", ["// Helpers that tell whether a file is generated.\n" + HAND]), 16: (None, [None]),
    }
    rows = [(i, p, "typescript", 10) for i, (p, _) in files.items()]
    pieces = [(i * 100 + n, i, n * 10 + 1, "function" if i == 14 else "config", t) for i, (_, ts) in files.items() for n, t in enumerate(ts)]
    f = spark.createDataFrame(rows + rows[:3], "id long, path string, language string, size long")
    c = spark.createDataFrame(pieces + pieces[:3] + [(9999, None, 1, "config", "x"), (9998, 777, None, "config", "x")], "id long, file_id long, line_start int, type string, text string")
    got = {r.id: r.kind for r in layout.judged(f, c).collect()}
    assert len(got) == len(files)
    assert {k: v for k, v in got.items() if v} == {2: "minified", 3: "data", 5: "vendored", 7: "lock", 8: "generated", 10: "vendored", 11: "generated", 14: "generated"}
    assert layout.judged(f.limit(0), c.limit(0)).count() == 0


def test_long_functions_count_for_uniformity(spark):
    body = lambda c, n: f"def load{c}(self):\n" + "".join(f"    self.field_{i} = reader.read_{c}_{i}({i})\n" for i in range(n)) + "    return self\n"
    texts = {1: [body(c, 30) for c in "ABCD"], 2: [body(c, 20 + 5 * n) for n, c in enumerate("ABCD")]}
    assert min(map(len, texts[1] + texts[2])) > 400
    f = spark.createDataFrame([(1, "r/src/a.py"), (2, "r/src/b.py")], "id long, path string")
    rows = [(i * 100 + n, i, n * 50 + 1, "function", t) for i, ts in texts.items() for n, t in enumerate(ts)]
    c = spark.createDataFrame(rows, "id long, file_id long, line_start int, type string, text string")
    assert {r.id: r.kind for r in layout.judged(f, c).collect()} == {1: "generated", 2: None}
