from collections import Counter, defaultdict

import corpus_pipeline as C
import public_tokenizers
from pixelloom.llm import quality
from tokenizers import Tokenizer

from .test_decontaminate import plain as plain_contamination
from .test_line_dedup import plain as plain_lines
from .test_simhash import groups

SF = "/root/testdata/sf0.01"


def similar_groups(texts):
    """Classes of documents under a Jaccard similarity of .8 of their five-word shingles, by an inverted index."""
    sets, index, common = {}, defaultdict(list), Counter()
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
        for g in sets[d]:
            index[g].append(d)
    for ds in index.values():
        common.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    return groups([p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)], list(texts))


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d for d, t in kept.items() if model.scores(quality.features(t)[None])[0] >= 0.7}
    for i, (name, stage) in enumerate(C.STAGES[:-1]):
        docs = C.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if i == 0:
            assert set(got) == want
        elif i == 1:
            assert got == {d: t for d, t, _, _ in plain_lines(list(kept.items()))}
        elif i == 2:
            lost, want = set(kept) - set(got), {d for g in similar_groups(kept) for d in g[1:]}
            print(f"near duplicates: {len(lost)} of {len(want)}")
            assert lost <= want and len(lost) >= 0.9 * len(want) and len(want) > 20
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(got) == {x[0] for x in plain_contamination(list(kept.items()), items) if not x[4]}
        kept = got
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in kept.values())


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


CLASHES = {"score": "double", "n_lines": "int", "n_dropped": "string", "node": "int", "label": "int", "row": "int", "w": "string", "h1": "int", "fp": "int", "hash": "int", "size": "int", "component_id": "int", "items": "int", "start": "int", "length": "int", "rank": "int"}


def test_odd_rows_and_clashing_columns(spark):
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").limit(12).select("text").collect()]
    rows = [(i, t) for i, t in enumerate(prose)] + [(None, prose[0]), (None, None), (3, prose[3]), (50, ""), (51, None), (52, prose[4] + " more"), (None, "a text of its own, without an id")]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in CLASHES.items())
    more = [str(k) if v == "string" else float(k) if v == "double" else k for k, v in enumerate(CLASHES.values())]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), *more) for i, t in rows], kinds)
    for part in (docs, docs.limit(0)):
        for name, stage in C.STAGES[:-1]:
            before, part = part.count(), C.stored(stage(spark, part, "/root/testdata/sf0.001"), name)
            assert part.columns == names and part.count() <= before
            got = part.select(*CLASHES).distinct().collect()
            assert len(got) <= 1 and all(list(r) == more for r in got), name
        assert C.STAGES[-1][1](spark, part, "/root/testdata/sf0.001").columns[0] == "doc_id"
