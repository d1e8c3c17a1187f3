"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

A text is segmented into the pieces whose scores sum highest (the vocabulary's unigram lattice; bytes stand in for characters without a
piece). best[p] = max over lengths of best[p - length] + score is a max-plus linear recurrence over the last WIDTH values, so a chunk of a
text acts on them as a WIDTH x WIDTH matrix. Texts longer than a chunk become rows of chunks: matrices are made independently, multiplied
along a text to give each chunk its entry state, each chunk then maps its exits to entries, the maps are composed backwards, and every
chunk backtraces alone. A chunk starts anywhere. Shorter texts are one chunk, whose entry and exit are known.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WIDTH = 16
SPACE, OTHER = "▁", "\ud800"  # the mark for a space; a stand-in for that character itself, which no valid text holds
NONE = -np.inf
GROUP = 4096  # words that are solved together
TOGETHER = 1 << 20  # bytes of texts that are held as Python objects at once
SLOTS = 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")  # a word with the marks before it; marks at the end are one, too


def vocabulary(path: str) -> dict:
    """Pieces with (id, score), byte ids, and the texts of ids, out of a model file of any type."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = {sp.id_to_piece(i): (i, float(sp.get_score(i))) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if max(map(len, plain)) > WIDTH or any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("pieces longer than 16 characters, or over a border of words, are not supported")
    return {"plain": plain, "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}, "fallback": min(s for _, s in plain.values()) - 10}


class _Lattice:
    """The best segmentations of many strings of one length at once; substrings are found by rolling hashes in a table of the pieces."""

    def __init__(self, plain: dict, fallback: float):
        pieces = list(plain)
        keys = np.array([self.hashed(p) for p in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        ids, scores = zip(*(plain[pieces[i]] for i in order), strict=True)
        self.fallback, self.ids, self.scores = fallback, np.array(ids, np.int32), np.append(np.array(scores), NONE)
        self.keys = keys[order]
        self.codes = np.array([[*map(ord, pieces[i]), *[0] * (WIDTH - len(pieces[i]))] for i in order], np.uint32)
        slots = (self.keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.first, self.longest = np.searchsorted(slots, np.arange(1 << SLOTS)).astype(np.int32), int(np.bincount(slots).max())

    @staticmethod
    def hashed(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF
        return h

    def found(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1."""
        at, out = self.first[h >> np.uint64(64 - SLOTS)], np.full(h.shape, -1, np.int32)
        for k in range(self.longest):
            i = np.minimum(at + k, len(self.keys) - 1)
            np.copyto(out, i, where=self.keys[i] == h)
        return out

    def solved(self, strings: list[str]) -> list[bytes | None]:
        """The ids of each; None where a character has no piece, or where a chosen piece only has the hash of one."""
        n, rows = len(strings[0]), len(strings)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n)
        steps, row = codes.T.astype(np.uint64) + np.uint64(1), np.arange(rows)
        h, piece, score = np.zeros((n, rows), np.uint64), np.full((min(n, WIDTH), n, rows), -1, np.int32), []
        for length in range(1, len(piece) + 1):
            h = (h[: n - length + 1] + steps[length - 1 :]) * _GOLD
            got = piece[length - 1, : n - length + 1] = self.found(h)
            score.append(self.scores[got])
        score[0][score[0] == NONE] = self.fallback
        best, back = np.zeros((n + 1, rows)), np.zeros((n + 1, rows), np.int64)
        for end in range(1, n + 1):
            low = max(0, end - WIDTH)
            total = np.stack([best[start] + score[end - start - 1][start] for start in range(low, end)])
            pick = total.argmax(axis=0)  # the first one: of equal sums the longest last piece
            best[end], back[end] = total[pick, row], low + pick
        # all strings are traced together, from the right
        out, wide, ok = np.zeros((rows, n), np.int32), np.pad(codes, ((0, 0), (0, WIDTH))), np.ones(rows, bool)
        at, end, place = row, np.full(rows, n), n
        while len(at):
            place -= 1
            start = back[end, at]
            i = piece[end - start - 1, start, at]
            here = np.where(np.arange(WIDTH) < (end - start)[:, None], wide[at[:, None], start[:, None] + np.arange(WIDTH)], 0)
            ok[at[(i < 0) | (here != self.codes[i]).any(axis=1)]] = False
            out[at, place] = self.ids[i]
            back[0, at] = place  # a string that is done begins at this place
            at, end = at[start > 0], start[start > 0]
        raw, begins = out.tobytes(), back[0].tolist()
        return [raw[4 * (k * n + begin) : 4 * (k + 1) * n] if fine else None for k, (begin, fine) in enumerate(zip(begins, ok.tolist(), strict=True))]


class Codec:
    def __init__(self, vocab: dict, limit: int = 300_000):
        self.plain, self.bytes, self.fallback = vocab["plain"], vocab["bytes"], vocab["fallback"]
        self.text_of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.plain.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.units, self.limit = {}, limit
        # every beginning of a piece, so that no longer piece is tried where none goes on
        self.scores = {}
        for piece, (_, score) in self.plain.items():
            for n in range(1, len(piece)):
                self.scores.setdefault(piece[:n], NONE)
            self.scores[piece] = score
        self.lattice = _Lattice(self.plain, self.fallback)
        # a character that no longer piece holds stands alone in every segmentation
        joining = "".join(re.escape(c) for c in sorted({c for piece in self.plain if len(piece) > 1 for c in piece}))
        self.parts, self.lone = re.compile(f"[{joining}]+|[^{joining}]", re.DOTALL), re.compile(f"[^{joining}]")

    @staticmethod
    def marked(text: str) -> str:
        return SPACE + text.replace(SPACE, OTHER).replace(" ", SPACE) if text else ""

    def edges(self, s: str, start: int):
        """(end, score) of the pieces of ``s`` that begin at ``start``, shortest first; a character without a piece has the fallback score."""
        for end in range(start + 1, min(len(s), start + WIDTH) + 1):
            score = self.scores.get(s[start:end])
            if score is None or score == NONE:
                if end == start + 1:
                    yield end, self.fallback
                if score is None:
                    return
            else:
                yield end, score

    def ids_of(self, piece: str) -> list[int]:
        got = self.plain.get(piece)
        if got:
            return [got[0]]
        return [self.bytes[b] for b in (SPACE if piece == OTHER else piece).encode("utf-8", "surrogatepass")]

    def solved(self, s: str, entry) -> tuple[list[float], list[int]]:
        """(best, start of the best last piece) at every position of ``s``, whose first len(entry) positions have the given values."""
        n, e, get = len(s), len(entry), self.scores.get
        best, back = list(entry) + [NONE] * (n + 1 - e), [-1] * (n + 1)
        for start in range(n):
            base = best[start]
            if base == NONE:
                continue
            # as ``edges``, written out; starts ascend, so that of equal sums the longest last piece stays
            end = start + 1
            score = get(s[start])
            total = base + (self.fallback if score is None or score == NONE else score)
            while True:
                if total > best[end] and end >= e:
                    best[end], back[end] = total, start
                if score is None or end == n:
                    break
                end += 1
                score = get(s[start:end])
                if score is None:
                    break
                total = base + score
        return best, back

    @staticmethod
    def entries(back: list[int], entries: int) -> list[int]:
        """The entry position of the best path to every position."""
        out = list(range(entries))
        for p in range(entries, len(back)):
            out.append(out[back[p]])
        return out

    def traced(self, s: str, back: list[int], exit_: int, entries: int) -> tuple[int, list[int]]:
        """(entry position, ids) of the best path that ends at ``exit_``."""
        cuts = [exit_]
        while cuts[-1] >= entries:
            cuts.append(back[cuts[-1]])
        ids = [i for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True) for i in self.ids_of(s[a:b])]
        return cuts[-1], ids

    def learn(self, units: set[str]) -> None:
        """Solves words that are not remembered: those of one length together."""
        parts = {s: self.parts.findall(s) for s in units if self.lone.search(s)}
        by_length = {}
        for part in units.difference(parts).union(*parts.values()):
            by_length.setdefault(len(part), []).append(part)
        solved = {}
        for n, some in by_length.items():
            for at in range(0, len(some), GROUP):
                group = some[at : at + GROUP]
                together = n <= 4 * WIDTH and len(group) >= 32
                solved.update(zip(group, self.lattice.solved(group) if together else [None] * len(group), strict=True))
        for s in [s for s, ids in solved.items() if ids is None]:
            solved[s] = np.array(self.traced(s, self.solved(s, [0.0])[1], len(s), 1)[1], np.int32).tobytes()
        for s in units:
            self.units[s] = b"".join([solved[part] for part in parts[s]]) if s in parts else solved[s]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """No piece goes over a border of words, so every distinct word is solved once and remembered."""
        words = [_UNITS.findall(self.marked(text)) for text in texts]
        if len(self.units) > self.limit:
            self.units.clear()
        self.learn(set().union(*words) - self.units.keys())
        return [np.frombuffer(b"".join(map(self.units.__getitem__, some)), np.int32) for some in words]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")

    def matrix(self, s: str, lead: int) -> np.ndarray:
        """The chunk s[lead:] as a matrix: entry positions (the WIDTH ones up to ``lead``) by exit positions (the last WIDTH)."""
        rows = np.full((len(s) + 1, WIDTH), NONE)
        rows[np.arange(lead - WIDTH + 1, lead + 1), np.arange(WIDTH)] = 0.0
        # a border of words, or a character that stands alone: all paths meet before it
        p = lead + 2
        while p <= len(s) and not ((s[p - 1] == SPACE and s[p - 2] != SPACE) or self.parts.fullmatch(s[p - 2 : p]) is None):
            p += 1
        front = s[: p - 1]
        for start in range(len(front)):
            for end, score in self.edges(front, start):
                if end > lead:
                    rows[end] = np.maximum(rows[end], rows[start] + score)
        if p <= len(s):  # from where all paths meet, one value tells all
            best, _ = self.solved(s[p - 1 :], [0.0])
            rows[p - 1 :] = np.array(best)[:, None] + rows[p - 1][None, :]
        return rows[len(s) - WIDTH + 1 :].T.copy()


def _forward(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry states of a text's chunks, by max-plus products along it."""
    pdf = pdf.sort_values("no")
    state, out = np.array([NONE] * (WIDTH - 1) + [0.0]), []
    for m in pdf["m"]:
        out.append(state.tobytes())
        state = (state[:, None] + np.frombuffer(m).reshape(WIDTH, WIDTH)).max(axis=0)
    return pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "state": out})


def _backward(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exits of a text's chunks: the last one leaves at its end, each other one where the next is entered."""
    pdf = pdf.sort_values("no", ascending=False)
    at, out = WIDTH - 1, []
    for m in pdf["ways"]:
        out.append(at)
        at = int(np.frombuffer(m, np.int64)[at])
    return pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "exit": out})


def _portions(batches, column: int, limit: int = TOGETHER):
    """The rows of batches, in order, in batches of texts of ``limit`` bytes at most; a longer text is one alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        at, held = 0, 0
        for row, size in enumerate(sizes):
            if row > at and held + size > limit:
                yield b.slice(at, row - at)
                at, held = row, 0
            held += size
        yield b.slice(at)


def _each(vocab, f, names, kind=None):
    def run(batches):
        codec = Codec(vocab.value)
        for b in _portions(batches, 3):
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f(codec, *r[2:]) for r in rows], kind)], names)

    return run


def _short(vocab):
    def run(batches):
        codec = Codec(vocab.value)
        for b in _portions(batches, 1):
            texts = b.column(1).to_pylist()
            ids = codec.encode_all(texts)
            exact = [codec.decode(i.tolist()) == text for i, text in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], ["id", "n_tokens", "ids", "exact"])

    return run


def _giants(texts: DataFrame, vocab, chunk: int) -> DataFrame:
    """(key, ids) of texts (key, text) longer than a chunk."""

    def cut(batches):
        for b in _portions(batches, 1):
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Codec.marked(text)
                for no, at in enumerate(range(0, len(s), chunk)):
                    # positions before the border may be starts of pieces over it
                    lead, body = _packed(s[max(0, at - WIDTH + 1) : at]), _packed(s[at : at + chunk])
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([no], pa.int64()), pa.array([lead]), pa.array([body])], ["key", "no", "lead", "body"])

    def whole(lead: bytes, body: bytes) -> str:
        return ("\0" * WIDTH + _unpacked(lead))[-(WIDTH - 1) :] + _unpacked(body)

    def matrix(codec, lead, body):
        return codec.matrix(whole(lead, body), WIDTH - 1).tobytes()

    def ways(codec, lead, body, state):
        s = whole(lead, body)
        best, back = codec.solved(s, np.frombuffer(state).tolist())
        first = codec.entries(back, WIDTH)
        return np.array([first[e] if best[e] > NONE else 0 for e in range(len(s) - WIDTH + 1, len(s) + 1)], np.int64).tobytes()

    def ids(codec, lead, body, state, exit_):
        s = whole(lead, body)
        _, back = codec.solved(s, np.frombuffer(state).tolist())
        return codec.traced(s, back, len(s) - WIDTH + 1 + exit_, WIDTH)[1]

    chunks = written(texts.mapInArrow(cut, "key string, no long, lead binary, body binary").repartition("key", "no"), "chunks")
    # matrices and maps are small (2 KB a chunk), so a text of any size that a row can hold fits one group
    made = chunks.mapInArrow(_each(vocab, matrix, ["key", "no", "m"], pa.binary()), "key string, no long, m binary")
    states = made.groupBy("key").applyInPandas(_forward, "key string, no long, state binary")
    entered = written(chunks.join(states, ["key", "no"]), "entered")
    back = entered.select("key", "no", "lead", "body", "state").mapInArrow(_each(vocab, ways, ["key", "no", "ways"], pa.binary()), "key string, no long, ways binary")
    exits = back.groupBy("key").applyInPandas(_backward, "key string, no long, exit long")
    parts = entered.join(exits, ["key", "no"]).select("key", "no", "lead", "body", "state", "exit").mapInArrow(_each(vocab, ids, ["key", "no", "ids"], pa.list_(pa.int32())), "key string, no long, ids array<int>")
    return parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))


def _packed(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


def _unpacked(b: bytes) -> str:
    return bytes(b).decode("utf-8", "surrogatepass")


def encoded(docs: DataFrame, model: str = MODEL, chunk: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids, exact (the ids decode to the text).

    Null and empty texts have no token. Repeated rows get equal results. Other columns are ignored. ``chunk`` changes no result.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(model))  # as large as the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("text"))

    def decoded(batches):
        codec = Codec(vocab.value)
        for b in _portions(batches, 1):
            texts, ids = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), b.column(2), pa.array([codec.decode(i) == x for i, x in zip(ids, texts, strict=True)], pa.bool_())], ["id", "n_tokens", "ids", "exact"])

    schema = f"id {kind}, n_tokens long, ids array<int>, exact boolean"
    giant = F.length("text") >= chunk  # one mark more than characters
    long = written(rows.where(giant).withColumn("key", F.md5(F.col("text").cast("binary"))), "giant-texts")
    found = _giants(long.select("key", "text").dropDuplicates(["key"]), vocab, chunk)
    out = rows.where(~giant).mapInArrow(_short(vocab), schema).unionAll(long.join(found, "key").select("id", "text", "ids").mapInArrow(decoded, schema))
    return out.withColumnRenamed("id", id_col)
