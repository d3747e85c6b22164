import math

import pytest
from pixelloom.llm import line_dedup as L

BLANKS = " \t\n\x0b\f\r"


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def plain(docs):
    owner = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            key = low(line.strip(BLANKS))
            if len(key) >= 10:
                owner[key] = min(owner.get(key, math.inf), math.inf if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        own = math.inf if d is None else d
        kept = [x for x in lines if owner.get(low(x.strip(BLANKS)), own) == own]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


DOCS = [
    (5, "A shared line here\nown line of five\nA shared line here"), (3, "  a SHARED line here\t\nthree's own line\n"), (9, "a shared line here"), (1, None), (2, ""),
    (7, "short\nshort\nÄhnliche Zeile\nÄHNLICHE ZEILE"), (8, "short\nähnliche zeile\nÄhnliche zeile\xa0"), (4, "\n\n\n"), (6, "x" * 200_000 + "\nfiller line 1"), (10, "x" * 200_000 + "\nfiller line 2"),
    (11, "dup id line one"), (11, "dup id line one\nanother line text"), (12, "another line text\ndup id line one"), (None, "a shared line here\nonly without id"), (None, "only without id"), (13, "ten chars!\n nine char"), (14, "TEN CHARS!\n nine char"),
    (9, "a shared line here"), (2**63 - 1, "the largest id there is\nonly without id"), (None, "the largest id there is"), (-4, "negative ids are first\nfiller line 2"), (20, "negative ids are first"),
]


def got(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "n", 7) for d, t in docs], "doc_id long, text string, n_lines string, id int")
    out = L.dedup_lines(df, **kw)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_dropped"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)


def test_against_plain_python(spark):
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        assert got(spark, DOCS, batches=batches, fanout=fanout) == sorted(plain(DOCS), key=repr)


def test_one_line_in_all_documents(spark):
    docs = [(i, f"the very common line\nline number {i}") for i in range(500)]
    assert got(spark, docs) == sorted(plain(docs), key=repr)


def run_tables(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_levelled_and_compacted(spark):
    with L.LineRuns(spark, fanout=2, buckets=2) as runs, L.ordered_scans(spark):
        for i in range(5):
            own = runs.add(spark.range(10 * i, 10 * i + 10).selectExpr("id AS h1", "-id AS h2", "id AS owner"))
            assert own.count() == 10 and own.columns == ["h1", "h2", "owner"]
        assert [len(x) for x in runs.levels] == [1, 0, 1] and len(run_tables(spark)) == 2
        assert runs.unseen(spark.range(45, 55).selectExpr("id AS h1", "-id AS h2")).count() == 5
        df = runs.unseen(spark.range(5).selectExpr("id AS h1", "-id AS h2"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # of the batch alone: runs are neither shuffled nor sorted
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and plan.count("SortMergeJoin") == 2
    assert not run_tables(spark) and spark.conf.get(L.ORDERED) == "false"


def test_nothing_is_left_after_a_failure(spark):
    with pytest.raises(Exception, match="broken"), L.LineRuns(spark, buckets=2) as runs:
        runs.add(spark.range(10).selectExpr("id AS h1", "id AS h2"))
        runs.add(spark.range(10).selectExpr("id AS h1", "CAST(raise_error('broken') AS BIGINT) AS h2"))
    assert not run_tables(spark)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_columns_of_the_names_within(spark):
    names = ["own_id", "own_hash", "id_of", "hash_of", "gone", "id", "at", "__own", "__gone"]
    df = spark.createDataFrame([(1, "a line of both", *names), (2, "a line of both\nown", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = L.dedup_lines(df, counts=False)
    assert out.columns == df.columns and {(r.doc_id, r.text, *r[2:]) for r in out.collect()} == {(1, "a line of both", *names), (2, "own", *names)}
