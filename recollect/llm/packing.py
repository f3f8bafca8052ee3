"""Packing of token sequences: length combinations weighted by non-negative least squares."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import Memo, materialize, small_batches, small_side

WINDOW = 2048
STEP = 8  # lengths are packed in units of so many tokens, rounded up
SALTED = 100_000  # pieces of one length ranked in one task, about
#: ASCII marks that the pre-tokenizer splits from a word before them (the apostrophe is not one).
MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{|}~'


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else 256 up."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


ASCII_MARKS = MARKS.encode()
#: Between a letter or digit and a mark the pre-tokenizer always splits.
FIRST_MARK = re.compile(rf"[{re.escape(MARKS)}](?<=[0-9A-Za-z\u00df-\u00f6\u00f8-\u00ff].)")
#: Lower-case letters of Latin-1 in UTF-8.
LOW_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(Memo):
    """word (UTF-8) -> its token ids as little-endian 32-bit bytes, found when first asked for.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    words in turn, and marks after a letter are words of their own. Words of Latin letters
    alone are one pre-token and go straight to the tokenizer's model, in lower case and byte
    letters as its normalizer leaves them, many in one call; all others go through the whole tokenizer. A word with
    capitals or marks is made of its lower-case letters' ids, which are kept as a word of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(250_000, 3 << 24)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Whether a token ends its word, as the model writes it.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix := self.model.end_of_word_suffix:
            self.ends[[i for token, i in self.plain.get_vocab().items() if token.endswith(suffix)]] = True
        self.ready: dict[bytes, bytes] = {}

    def parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word's Latin letters in lower case and the marks after them; None of any other word."""
        core = word.rstrip(ASCII_MARKS)
        if core.isalpha():  # of bytes: ASCII letters alone
            return core.lower(), word[len(core) :]
        text = core.decode("utf-8", "replace")
        low = text.lower()
        return (low.encode(), word[len(core) :]) if low.isalpha() and max(low) < "\u0250" and "\u0130" not in text else None

    def spelt(self, core: bytes) -> str:
        return core.decode() if core.isascii() else core.decode("latin-1").translate(self.letters)

    def make(self, word: bytes) -> bytes:
        if (found := self.ready.get(word)) is not None:
            return found
        if (parts := self.parts(word)) is None:
            return packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        core, marks = parts
        if core == word:
            return packed([t.id for t in self.model.tokenize(self.spelt(word))])
        return self[core] + self[marks] if marks else self[core]

    @staticmethod
    def parted(text: str) -> list[bytes]:
        """Words of a text; if it is all Latin-1 and holds no special token, in lower case and with marks parted from letters before
        them, which changes no id and leaves fewer different words."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = FIRST_MARK.sub(r" \g<0>", text.lower())
            except UnicodeEncodeError:
                pass
        return text.encode("utf-8", "replace").split()

    def prepare(self, words: set[bytes], size: int = 200) -> None:
        """Tokenize all words of lower-case Latin-1 letters that are not kept yet, `size` in a call; a call's ids are cut where tokens end a word.
        If these are not one a word, the words are left to `make`, as are all others."""
        self.ready = {}
        cores = list(filter(LOW_LETTERS.fullmatch, words.difference(self, self.old)))
        for i in range(0, len(cores), size):
            some = cores[i : i + size]
            ids = self.plain.encode_batch_fast([" ".join(map(self.spelt, some))], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) == len(some):
                raw, stops = ids.tobytes(), stops.tolist()
                self.ready.update((c, raw[s:e]) for c, s, e in zip(some, [0, *stops], stops))

    def of(self, text: str | None) -> bytes:
        return next(self.of_all([text]))

    def of_all(self, texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[bytes]:
        """Each text's ids. Words of texts of about `size` characters together, and of slices of longer ones, are looked up once."""
        group: list[list[bytes]] = []
        held = 0
        for text in texts:
            group.append(self.parted(text) if text else [])
            held += len(text or "")
            if held >= size:
                yield from self._joined(group)
                group, held = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[bytes]], most: int = 1 << 18) -> Iterator[bytes]:
        if len(group) == 1 and len(group[0]) > most:
            words = group[0]
            yield b"".join([next(self._joined([words[i : i + most]])) for i in range(0, len(words), most)])
            return
        distinct = set(chain.from_iterable(group))
        self.prepare(distinct)
        found = {w: self[w] for w in distinct}
        self.ready = {}
        for words in group:
            yield b"".join(map(found.__getitem__, words))


@lru_cache(maxsize=2)
def shared_words(path: str) -> WordIds:
    """One table a worker process, which goes on from task to task."""
    return WordIds(path)


def _cutter(tokenizer: str, end_id: int, window: int):
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared_words(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], words.of_all(batch["text"]), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return cut


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut at multiples of the window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInPandas(
        _cutter(tokenizer or default_tokenizer(), end_id, window),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |ax - b| with x >= 0."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    for _ in range(rounds):
        slope[used] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1.0) > 0:
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12]
            if not len(gone):
                gone = at[[int(np.argmin(s))]]
            used[gone], x[gone] = False, 0.0
            if not used.any():
                break
        x[:] = 0
        at = np.flatnonzero(used)
        if len(at):
            x[at] = s
        slope = a.T @ (b - a @ x)
    return x


def combinations_filling(units: int, depth: int) -> list[tuple[int, ...]]:
    """Unit lengths, largest first, of up to `depth` pieces that fill the window exactly."""
    found = [(units,)]
    for size in range(2, depth + 1):
        for head in combinations_with_replacement(range(units - 1, 0, -1), size - 1):
            rest = units - sum(head)
            if 0 < rest <= head[-1]:
                found.append((*head, rest))
    return found


def packing_plan(histogram: dict[int, int], units: int, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: patterns {unit length: pieces} that use up the histogram exactly.

    Combinations of at most `depth` pieces that fill the window are weighted by non-negative
    least squares and rounded down; what remains is packed greedily, longest piece first, each
    pattern as often as the remainder allows. The work depends on `units`, not on the counts.
    """
    left = {k: v for k, v in histogram.items() if v}
    plan: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(k, 0) // m for k, m in pattern.items())])
        if times > 0:
            plan.append((pattern, times))
            for k, m in pattern.items():
                left[k] -= m * times
                if not left[k]:
                    del left[k]

    take({units: 1}, left.get(units, 0))
    if left:
        combos = [c for c in combinations_filling(units, depth) if all(k in left for k in c)]
        if combos:
            keys = sorted(left)
            row = {k: i for i, k in enumerate(keys)}
            a = np.zeros((len(keys), len(combos)))
            for j, c in enumerate(combos):
                for k in c:
                    a[row[k], j] += 1
            weights = nnls(a, np.array([left[k] for k in keys], float))
            for j in np.argsort(-weights, kind="stable"):
                if weights[j] >= 1:
                    take({k: combos[j].count(k) for k in set(combos[j])}, int(weights[j]))
    while left:
        room, pattern = units, {}
        for k in sorted(left, reverse=True):
            if m := min(left[k], room // k):
                pattern[k] = m
                room -= m * k
        take(pattern, min(left[k] // m for k, m in pattern.items()))
    return plan


def _placer(plan: list[tuple[dict[int, int], int]]):
    """(unit length, rank) -> (sequence, place): the plan's ranges of ranks, looked up by bisection."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        for k, m in pattern.items():
            ranges.setdefault(k, []).append((used.get(k, 0), first, m))
            used[k] = used.get(k, 0) + m * times
        first += times
    tables = {k: np.array(v, np.int64).T for k, v in ranges.items()}

    @F.pandas_udf("sequence_id long, place int")
    def place(unit: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(unit)), np.int64)
        for k in unit.unique():
            at = np.flatnonzero(unit.to_numpy() == k)
            low, base, m = tables[int(k)]
            r = rank.to_numpy()[at]
            i = np.searchsorted(low, r, side="right") - 1
            out[0, at] = base[i] + (r - low[i]) // m[i]
            out[1, at] = (r - low[i]) % m[i]
        return pd.DataFrame({"sequence_id": out[0], "place": out[1].astype(np.int32)})

    return place


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    step: int = STEP,
    depth: int = 3,
) -> DataFrame:
    """Pack whole documents into sequences of at most `window` tokens.

    A document's ids and `end_id` are cut at multiples of the window; only its last piece is
    shorter. Pieces are counted by length in units of `step` tokens (a histogram of
    window / step rows, the one thing the driver gets), planned by packing_plan and dealt to
    their sequences by rank among equal lengths. Ranks are per length and salt, and salts grow
    with the pieces, so that a length that a third of all rows share is counted in many tasks.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table
    gives an empty result. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, the piece's place in its sequence.
    """
    units = window // step
    unit = F.ceil(F.col("length") / step).cast("int")
    pieces = token_pieces(docs, tokenizer, end_id, window)
    pieces = materialize(pieces.withColumn("_unit", unit), "pack-pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("_unit").count().collect()}  # at most units rows
    plan = packing_plan(histogram, units, depth)
    salts = max(64, max(histogram.values(), default=0) // SALTED)
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("_salt", salt)
    counts = materialize(pieces.groupBy("_unit", "_salt").agg(F.count("*").alias("_n")), "pack-counts")

    before = Window.partitionBy("_unit").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_unit", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_unit", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(within) - 1)
    ranked = ranked.join(small_side(offsets), ["_unit", "_salt"])
    put = ranked.withColumn("_put", _placer(plan)("_unit", F.col("_off") + F.col("_in")))
    put = put.withColumn("sequence_id", F.col("_put.sequence_id")).withColumn("_place", F.col("_put.place"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_unit"), "_place")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return put.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )


