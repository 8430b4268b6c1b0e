import random
import re

import duckdb
import pytest

from candlewick.llm import line_dedup as ld

LINE = "one two three four five six seven eight nine ten eleven"


def brute(docs, min_words=10):
    """For docs (doc_id, text), in their order: units, units that go, spans that go and that other rows have."""
    seen, rows, held = {}, [], {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k)):
        found, at = [], 0
        for piece in re.sub(r"([.!?,;:]+[ \t\x0b-\r]+|\n)", "\\1\0", docs[k][1] or "").split("\0"):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), piece))
            if words:
                found.append((at, at + len(piece.rstrip(" \t\n\x0b\x0c\r")), words))
            at += len(piece)
        count = lambda i, j: sum(len(w) for _, _, w in found[i : j + 1])
        all_runs = [(i, j) for i in range(len(found)) for j in range(i, len(found)) if count(i, j) >= min_words]
        own = [(i, j) for i, j in all_runs if count(i, j - 1) < min_words or (j == len(found) - 1 and count(i + 1, j) < min_words)]
        digests = [" ".join(w for _, _, x in found[i : j + 1] for w in x) for i, j in own]
        goes = [(i, j, docs[seen.setdefault(d, (k, i, j))[0]][0]) for (i, j), d in zip(own, digests) if seen.setdefault(d, (k, i, j)) != (k, i, j)]
        for d in set(digests):
            held.setdefault(d, []).append(k)
        rows.append((k, found, own, digests, goes))
    out = {}
    for k, found, own, digests, goes in rows:
        shared = [(i, j, docs[seen[d][0]][0]) for (i, j), d in zip(own, digests) if len(held[d]) > 1]
        out[k] = (len(own), len(goes), *(_joined(found, x) for x in (goes, shared)))
    return out


def _joined(found, runs):
    out = []
    for i, j, f in sorted(runs, key=lambda r: r[:2]):
        if out and i <= out[-1][1] + 1:
            out[-1][1] = max(j, out[-1][1])
        else:
            out.append([i, j, f])
    return [(found[i][0], found[j][1], f, sum(len(w) for _, _, w in found[i : j + 1])) for i, j, f in out]


def corpus():
    random.seed(5)
    marks = ["", "", "", ", ", ". ", "; ", "!! \t", "\n", " \n\n", ".", ":"]
    prose = lambda n: " ".join(random.choice(["Été", "b", "two", "x-y", "中", "3", "w"]) + str(random.randrange(99)) + random.choice(marks) for _ in range(n))
    passage, verse = prose(59), "one two\n\nthree four five\nsix seven\neight nine\nten eleven twelve\nend"
    docs = [(7, prose(80) + " " + passage + " " + prose(70)), (3, f"{prose(20)} {passage.upper()} tail of one line"), (9, prose(30) + passage), (None, passage), (4, None), (5, ""), (6, "one two, " * 90), (8, prose(49))]
    docs += [(7, docs[0][1])] + [(20 + k, prose(30) + passage[:200] + prose(60)) for k in range(3)] + [(30, f"first\n{verse}\nlast"), (29, verse), (31, " \n,. !\n"), (32, "a b c d e f g h i j"), (33, "A b c, d e f. g h i j")]
    return docs + [(40 + k, "\n".join([prose(random.randrange(30))] + ["in all texts: one line, of ten words and some more."] + [prose(9)])) for k in range(20)]


@pytest.mark.parametrize("min_words", [10, 4])
def test_spans_equal_brute_force(spark, min_words):
    docs = corpus()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, row int").coalesce(1)
    expected = brute(docs, min_words)
    for r in ld.spans(df, min_words).collect():
        got = (r.n_units, r.n_removed, *([tuple(x) for x in s] for s in (r.removed, r.shared)))
        assert got == expected[r.row], docs[r.row]
    assert ld.spans(df.limit(0)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    docs = [d for d in corpus() if d[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = ld.op8_line_hashing(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(ld.ORACLE).df()[got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.values.tolist()), key=str)


def test_passages_inside_lines_go_and_the_first_stays(spark):
    random.seed(2)
    prose = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) + random.choice(["", "", "", "", ".", ","]) for _ in range(n))
    passage = prose(60)
    docs = [(k, f"{prose(40)} {passage} {prose(40)}" if k % 2 else prose(140)) for k in range(40)]
    found = {r.doc_id: r for r in ld.spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert [k for k in range(40) if any(x.n_words >= ld.PASSAGE_WORDS for x in found[k].removed)] == list(range(3, 40, 2))
    assert [k for k in range(40) if any(x.n_words >= ld.PASSAGE_WORDS for x in found[k].shared)] == list(range(1, 40, 2))
    assert all(x.first_doc_id == 1 for k in range(3, 40, 2) for x in found[k].removed)


def test_cleaned_keeps_the_rest_and_every_column(spark):
    texts = [(3, f"intro\n{LINE.upper()}!\nend"), (1, f"{LINE}\n{LINE}"), (2, f"short\nshort\n{LINE}"), (4, None), (5, ""), (2, f"short\nshort\n{LINE}"), (6, f"Also: {LINE}. then more, and {LINE}")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, row string, removed int").coalesce(1)
    got = ld.cleaned(df).collect()
    assert [(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r.doc_id, r.text or ""))] == [
        (1, LINE), (2, ""), (2, "short\nshort"), (3, "intro\nend"), (4, None), (5, ""), (6, f"Also: then more, and {LINE}"),
    ]
    assert all(r.row == "x" for r in got)


def test_long_texts_are_read_whole(spark):
    body = " ".join(f"w{k}{'.' if k % 9 == 0 else ''}" for k in range(200_000))
    found = {r.doc_id: r for r in ld.spans(spark.createDataFrame([(1, body), (2, f"Head. {body}")], "doc_id long, text string")).collect()}
    assert found[1].removed == [] and [(x.first_doc_id, x.n_words) for x in found[2].removed] == [(1, 200_000)]


def test_without_cuts_spans_with_what_they_leave_empty():
    assert ld.without("ab\ncd\nef", [(0, 2)]) == "cd\nef"
    assert ld.without("ab\ncd\nef", [(3, 5)]) == "ab\nef"
    assert ld.without("ab\n cd \nef", [(4, 6)]) == "ab\nef"
    assert ld.without("ab\ncd\nef", [(6, 8)]) == "ab\ncd"
    assert ld.without("ab", [(0, 2)]) == ""
    assert ld.without("ab cd. ef", [(3, 6)]) == "ab ef"
    assert ld.without("ab. cd\nef", [(4, 6)]) == "ab.\nef"
    assert ld.without("ab. cd\nef gh", [(4, 9)]) == "ab. gh"
