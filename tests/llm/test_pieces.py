import itertools
import random
from types import SimpleNamespace

import pyarrow as pa
from cases import awkward, clashing, documents, real
from wireloom.llm import pieces as P


def codec():
    return P.Codec(P.vocabulary(P.MODEL))


def test_segmentation_is_the_best_of_all():
    c = codec()
    for s in ("▁thereon", "▁naïve▁x", "▁a▁the", "▁日本語", "▁🙂ab"):
        scores = []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, x in enumerate(cuts) if x], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            if all(p in c.plain or len(p) == 1 for p in parts):
                scores.append(sum(c.plain[p][1] if p in c.plain else c.fallback for p in parts))
        assert c.solved(s, [0.0])[0][-1] == max(scores)


def test_library_agrees_on_words_in_its_own_lattice():
    """The same file read as a unigram model; words are short enough for its single-precision sums."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(open(P.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    sp, c = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), codec()
    rnd = random.Random(4)
    for _ in range(300):
        w = "".join(rnd.choice(["th", "er", "ing", "an", "on", "é", "z", "qu", "x", "."]) for _ in range(rnd.randint(1, 6)))
        a, b = sp.encode(w), c.encode(w)
        score = lambda ids: sum(sp.get_score(i) for i in ids)
        assert a == b or score(a) == score(b)


def test_words_solved_together_are_those_solved_alone():
    """Words of one length go through one lattice; alone each goes through the plain recurrence. Ties, characters without a piece and long words, too."""
    rnd = random.Random(7)
    parts = ["th", "er", "ing", "an", "on", "é", "z", "qu", "x", ".", "aa", "a", "日", "本", "\u0378", "🙂", "0", "tion", "\n"]
    texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(400)) + " " * rnd.randint(0, 3) for _ in range(20)]
    texts += ["", " ", "a" * 100, "▁ ▁▁ x"]
    together, alone = codec(), codec()
    got = together.encode_all(texts)
    assert [len(together.units) > 64 * 32, len(got)] == [True, len(texts)]
    for text, ids in zip(texts, got, strict=True):
        marked, want = alone.marked(text), []
        for unit in P._UNITS.findall(marked):
            want += alone.traced(unit, alone.solved(unit, [0.0])[1], len(unit), 1)[1]
        assert ids.tolist() == want and together.decode(ids.tolist()) == text


def test_one_hash_for_two_strings_is_noticed():
    c = codec()
    words = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    want = [c.encode(w) for w in words]
    c.units.clear()
    c.lattice.codes[:] = 1  # as if every chosen piece only had the hash of another string
    assert c.lattice.solved([P.SPACE + w for w in words]) == [None] * len(words)
    assert [i.tolist() for i in c.encode_all(words)] == want


def test_long_batches_are_encoded_in_portions():
    """However many rows come at once, texts of a bounded size are held and handed on together; no row is lost or moved."""
    line = "the quick brown fox jumps over the lazy dog, naïve 日本語 " * 40
    texts = [f"{i} {line[: i % 2000]}" for i in range(3000)] + ["", "x " * P.TOGETHER] + [""] * 3
    ids = pa.array(range(len(texts)), pa.int64())
    batches = [pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["id", "text"]), pa.RecordBatch.from_arrays([ids[:0], pa.array([], pa.string())], ["id", "text"])]
    out = list(P._short(SimpleNamespace(value=P.vocabulary(P.MODEL)))(batches))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sum(len(texts[i].encode()) for i in b.column(0).to_pylist()) for b in out]
    assert sum(size > P.TOGETHER for size in sizes) == 1 and len(sizes) < 20
    c, got = codec(), [x for b in out for x in b.column(2).to_pylist()]
    assert all(b.column(3).to_pylist() == [True] * len(b) for b in out) and got[:200] == [c.encode(t) for t in texts[:200]]
    assert [len(x) for x in got] == [n for b in out for n in b.column(1).to_pylist()]


def test_chunks_change_nothing(spark, sf):
    c = codec()
    texts = [r.text for r in real(spark, sf, 6).collect()] + ["x" * 500, "the " * 200 + " " * 90 + "é▁🙂" * 60, "ab" * 64, "a" * 127, "a" * 128, "a" * 129]
    got = {r.doc_id: r for r in P.encoded(documents(spark, texts), chunk=64).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == c.encode(t) and got[i].exact and got[i].n_tokens == len(got[i].ids)


def test_awkward_rows_and_empty_table(spark):
    df = clashing(awkward(spark))
    rows = P.encoded(df).collect()
    assert len(rows) == df.count() and all(r.exact for r in rows)
    assert P.encoded(documents(spark, [])).count() == 0
