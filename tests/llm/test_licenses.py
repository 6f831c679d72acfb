from hearthline.llm import licenses

N = licenses.WORDS


def shingles(words):
    return [tuple(words[i : i + N]) for i in range(len(words) - N + 1)]


def brute(rows):
    out = {}
    known = {k: set(shingles(licenses.template_words(t))) for k, t in licenses.TEMPLATES.items()}
    for d, text in rows:
        s = shingles(licenses.template_words(text or ""))
        for k, own in known.items():
            size = licenses.size_class(len(own))
            for a in range(0, len(s), size):
                share = len(set(s[a : a + 2 * size]) & own) / len(own)
                if share * 100 >= licenses.SHARE:
                    out[(d, k)] = max(out.get((d, k), 0), share)
    return out


def test_brute_force(spark, table, duck):
    docs = table("documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    rows += [
        (9001, "word " * 700 + mit + " and more"), (9002, mit[: len(mit) // 2]), (9003, mit.replace("Software", "Program")),
        (9004, mit.replace("limitation", "limits")), (9005, "x " * 37 + apache.upper() + " y" * 99), (9006, apache.replace("\n", " ").replace(",", " ; ")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = licenses.scan(docs).collect()
    assert sorted(map(tuple, found), key=str) == duck(licenses.sql(), documents=docs)
    assert {(r.doc_id, r.license): r.containment for r in found} == brute(rows)
    by = {(r.doc_id, r.license): r for r in found}
    one = by[(9001, "MIT")]
    assert (one.first_word, one.end_word) == (700, 700 + len(licenses.template_words(mit)))
    assert (9004, "MIT") in by and (9002, "MIT") not in by


def test_only_native_functions(spark, table):
    plan = licenses.scan(table("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    line = licenses.TEMPLATES["MIT-notice"]
    rows = [(1, None, "a"), (2, "", "b"), (3, "under the", "c"), (None, line, "d"), (None, line, "d"), (4, line + " x" * 300_000 + " " + line, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert set(found) == {None, 4}
    assert (found[4].first_word, found[4].end_word) == (0, 300_010) and found[None].windows == 2
    assert licenses.scan(docs.limit(0)).count() == 0
    try:
        licenses.scan(docs, {"short": "a b c"})
        raise AssertionError("short templates cannot be found")
    except ValueError:
        pass
