import public_tokenizers
import sentencepiece
from pixelloom.llm.token_count import _Lengths, count_tokens, frequent_lengths, lookups, marked_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a\n", "a\nb c", "a \nb", "a\n b", "a  b", "a   \n  b", "\n\n\na", "x" * 5000, "a▁b", "▁", "<s>x</s> <unk>", "é ñ ﬁ 漢字\t1234", "a\x00b \r\n", "日本 語", "🙂🙂 ok", "a b " * 3000,
]


def test_every_text_counts_as_the_library_counts(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    lengths = _Lengths(PATH, {})
    assert [sum(lengths[u] for u in marked_words(t)) for t in TEXTS] == [len(lib.encode(t)) for t in TEXTS]
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "a", "a"])]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = {(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t, _ in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_whole_table(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    assert got == {r.doc_id: len(lib.encode(r.text)) for r in docs.collect()}


def test_tiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lookups(docs, PATH).first()
    print(r)
    assert r.units == r.first + r.second + r.library == sum(len(marked_words(x.text or "")) for x in docs.collect()) and r.first > 0.7 * r.units
    few = frequent_lengths(docs, PATH, sample=20, most=50)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(few) == 50 and all(n == len(lib.encode(u)) for u, n in few.items() if u and u[0] not in " \n")


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
