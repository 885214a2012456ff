import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from quarry.llm import sentencepieces as s


def small_model(pieces, byte_fallback=True, prefix=True, squeeze=False, model_type=2):
    """A hand-written merge vocabulary of (piece, score, type)."""
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = model_type, byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", prefix
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    rows = [("<unk>", 0, s.UNKNOWN), ("<s>", 0, s.CONTROL), ("</s>", 0, s.CONTROL)]
    if byte_fallback:
        rows += [(f"<0x{i:02X}>", 0, s.BYTE) for i in range(256)]
    for piece, score, kind in [*rows, *pieces]:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


LETTERS = [(c, -100 - k, s.NORMAL) for k, c in enumerate("abcdé")] + [(s.MARK, -99, s.NORMAL)]
MODELS = {
    "ties": small_model([*LETTERS, ("ab", -1, 1), ("bc", -1, 1), ("ca", -1, 1), ("abc", -1, 1), ("▁a", -1, 1), ("aa", -2, 1)]),
    "unused": small_model([*LETTERS, ("ab", -1, s.UNUSED), ("abc", -2, s.NORMAL), ("cd", -3, s.NORMAL), ("abab", -4, s.UNUSED)]),
    "user": small_model([*LETTERS, ("ab", -1, 1), ("bcd", 0, s.USER_DEFINED), ("bc", 0, s.USER_DEFINED), ("da", -2, 1), ("▁a", -3, 1)]),
    "no bytes": small_model([*LETTERS, ("ab", -1, 1), ("▁b", -2, 1)], byte_fallback=False),
    "no prefix": small_model([*LETTERS, ("ab", -1, 1), ("▁b", -2, 1)], prefix=False),
    "squeezed": small_model([*LETTERS, ("ab", -1, 1), ("▁b", -2, 1)], squeeze=True),
    "across words": small_model([*LETTERS, ("ab", -3, 1), ("b▁", -1, 1), ("b▁a", -2, 1)]),
    "signs": small_model([*LETTERS, (".", -98, 1), ("c.", -1, 1), ("..", -2, 1), ("ab", -3, 1), ("\na", -4, 1), ("bc", -5, 1)]),
}


def random_texts(alphabet, n=1500, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("name", MODELS)
def test_small_vocabularies_as_the_library(name):
    ours, theirs = s.Merges(MODELS[name], memo_parts=50), sentencepiece.SentencePieceProcessor(model_proto=MODELS[name])
    for text in random_texts("abcdabcd  é.x\n▁"):
        ids = theirs.encode(text)
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids), text
        assert s.text_of(ours, text, ids) == theirs.decode(ids), text
    texts = random_texts("abcd  é.x\n▁")
    assert ours.encode_texts(texts) == [",".join(map(str, theirs.encode(t))) for t in texts]


def test_production_vocabulary_as_the_library():
    with open(s.model_path(), "rb") as f:
        raw = f.read()
    ours, theirs = s.Merges(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in [*random_texts(" ▁\n\0ab the in er . , 0 é ß 中 😀 ① ́�²-'"), "a" * 5000, "ab" * 3000 + " " * 40 + "x", "<s>x</s><unk><0x41>"]:
        ids = theirs.encode(text)
        assert ours.encode(text) == ids and ours.decode(ids) == theirs.decode(ids), text
    rnd = random.Random(1)
    for _ in range(3000):  # ids that no text gives: broken bytes, control and unknown ids
        ids = [rnd.choice([rnd.randint(0, 2), rnd.randint(3, 258), rnd.randint(259, 31_999), 28705]) for _ in range(9)]
        assert ours.decode(ids) == theirs.decode(ids), ids


def brute(model, text):
    """The best adjacent pair of the whole text, over and over."""
    sym = list(model.normal(text))
    while True:
        best = min(((model.order[a + b], k) for k, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in model.order), default=None)
        if best is None:
            break
        sym[best[1]:best[1] + 2] = ["".join(sym[best[1]:best[1] + 2])]
    return [i for x in sym for i in ([model.ids[x]] if x in model.ids else [model.byte_ids[b] for b in x.encode()])]


def test_agenda_against_brute_force():
    with open(s.model_path(), "rb") as f:
        ours = s.Merges(f.read())
    for text in random_texts("the of and nation, er.\nin  ing é", 300):
        assert ours.encode(text) == brute(ours, text), text


@pytest.mark.parametrize("name", ["ties", "signs", "production"])
def test_many_parts_at_once_as_one_by_one(name):
    with open(s.model_path(), "rb") as f:
        ours = s.Merges(MODELS.get(name) or f.read())
    parts = sorted({p for t in random_texts("abcdabcd  é.xthe nation,\n😀①") for p in ours.parts(ours.normal(t))})
    assert ours.pairs.merged(parts) == [",".join(map(str, ours._part_ids(p))) for p in parts]
    assert ours.pairs.merged([]) == [] and ours.pairs.merged(["▁"]) == [",".join(map(str, ours._part_ids("▁")))]


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["ab", None, "c" * 50, "", "é" * 4, "d", "e"]})
    got = list(s.slices(batch, 10))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist() and len(got) > 2
    assert list(s.slices(batch.slice(0, 0))) == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        s.Merges(small_model(LETTERS, model_type=1))


def test_defined_cases(spark, make_docs, edge_rows):
    got = s.encode_documents(make_docs(edge_rows, extra=True), s.model_path(), keep=True).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=s.model_path())
    want = []
    for i, t in edge_rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True, ids, lib.decode(ids)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert s.encode_documents(make_docs([]), s.model_path()).count() == 0


def test_the_check_sees_a_wrong_word(spark):
    with open(s.model_path(), "rb") as f:
        both = s.Checked(f.read())
    texts = ["the good word", "the bad word", "bad  spaces", ""]
    assert both.encode_texts(texts)[1] == [True] * 4
    both.ours.memo["▁bad"], both.ours.older = "7", {}
    both.ours.fresh.append(("bad", "7"))
    assert both.encode_texts(texts)[1] == [True, False, False, True]


def test_texts_are_decoded_from_their_ids():
    with open(s.model_path(), "rb") as f:
        raw = f.read()
    both, lib = s.Checked(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["one two", "one  two", "日本語 ok", "\0é\u2582 😀", " ", ""]
    assert both.encode_texts(texts) == ([",".join(map(str, lib.encode(t))) for t in texts], [True] * 6,
                                        [lib.decode(lib.encode(t)) for t in texts])
    two = both.ours.ids["▁two"]
    both.ours.raw = pa.array([v if i != two else b" 2" for i, v in enumerate(both.ours.raw.to_pylist())], pa.binary())
    assert both.encode_texts(texts[:2])[1:] == ([False, False], ["one 2", "one  2"])
    for given in ("1,2", "", f"{two},7"):  # ids of no text: nothing is taken from one
        assert s.text_of(s.Merges(raw), "another text", given) == lib.decode(list(map(int, given.split(","))) if given else [])


@pytest.mark.parametrize("name", [*MODELS, "production"])
def test_many_texts_are_decoded_as_one_by_one(name):
    with open(s.model_path(), "rb") as f:
        ours = s.Merges(MODELS.get(name) or f.read())
    rnd = random.Random(2)
    some = [[rnd.randint(3 if k % 2 else 0, len(ours.surface) - 1) for _ in range(k % 9)] for k in range(3000)]
    assert ours.decode_texts([",".join(map(str, ids)) for ids in some]) == list(map(ours.decode, some))
    assert ours.decode_texts([]) == []


def test_whole_texts_are_compared(spark, make_docs, edge_rows):
    got = s.encode_documents(make_docs(edge_rows), s.model_path(), whole=True).collect()
    assert len(got) == len(edge_rows) and all(r["agrees"] for r in got)


def test_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = s.op11_sentencepiece(spark, sf)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r["agrees"] for r in rows)
