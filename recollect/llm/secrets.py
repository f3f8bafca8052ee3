"""Secret scan: patterns, and strings that a dictionary-primed compressor finds novel."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, materialize, small_batches, small_side

# The patterns of the three base kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CUES = (
    "access", "api", "apikey", "auth", "authorization", "basic", "bearer", "cert", "certificate", "cookie", "credential", "credentials", "hash", "key",
    "keys", "login", "passphrase", "passwd", "password", "pin", "private", "pwd", "salt", "secret", "secrets", "session", "sig", "signature", "token", "tokens",
)
#: How strings that are secrets by their form begin.
PREFIXES = ("AIza", "AKIA", "eyJ", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "hf_", "npm_", "pypi-", "rk_live_", "sk-", "sk_live_", "xoxb-", "xoxp-")
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the compressor knows beforehand: words of code, configuration and prose about them.
PRIMER = (
    "abstract access account address admin algorithm allow api application argument array async attribute auth "
    "authorization backend base64 bearer binary boolean branch buffer build bytes cache callback certificate char "
    "class client cloud code column command comment commit common config configuration connect connection const "
    "constructor container content context cookie count create credential crypto current data database date debug "
    "decode default define delete deploy description development device directory docker document domain double "
    "element email enable encode encoding endpoint engine entity environment error event example exception execute "
    "export expression extend false field file filter final float folder format function generate global group "
    "handler hash header host http https identifier image implement import include index info init input insert "
    "instance integer interface internal invoke iterator java javascript json key label language length level "
    "library license limit link linux list local localhost location logger login main manager map master maximum "
    "memory message metadata method minimum model module mongodb mysql name namespace network node null number "
    "object offset operation option order output package parameter parent parse password path pattern payload "
    "permission placeholder platform pointer port postgres prefix private process production profile project "
    "property protected protocol provider proxy public python query queue random read record redirect redis "
    "reference region register release remote repository request require resource response result return role root "
    "route row sample schema scope script secret section secure select sequence server service session setting "
    "signature size socket source sql ssh start state static status storage stream string struct style subject "
    "submit subscription suffix switch sync system table tag target task template test text thread time timeout "
    "timestamp title token tracking transaction true type undefined unique update upload url user username utils "
    "value variable vector version view virtual void volume web webhook width window worker wrapper write xml yaml"
)


@dataclass(frozen=True)
class Novelty:
    """A candidate has at least `least` characters and letters of both cases or letters and digits. Its
    context is sensitive if a telling word stands within `near` characters on either side, if it
    is a quoted value given to a name, the password of a URL, begins as secrets do, or goes on
    with a novel string before it. It is novel if, after the dictionary and `around` characters of text
    on both sides, it adds `share` bytes or more a character: what matches nothing costs its bytes, of
    whatever alphabet it is, for the compressor writes literals plainly."""

    least: int = 12
    near: int = 64
    around: int = 256
    share: float = 0.8


#: What the compressor can't match, after the text in both measurements, so that its end is alike in both.
TAIL = sha256(b"tail").digest()[:16]

Span = tuple[int, int, int]  # start, place in KINDS, end


class Scanner:
    def __init__(self, novelty: Novelty = Novelty(), dictionary: bytes = b""):
        import zstandard

        self.novelty = novelty
        self.assign, self.access, self.hex = re.compile(ASSIGN, re.A), re.compile(ACCESS), re.compile(HEX)
        self.candidate = re.compile(rf"[A-Za-z0-9+/_~][A-Za-z0-9+/_=~.-]{{{novelty.least - 2},}}[A-Za-z0-9+/_=~-]")
        # A telling word is whole, or a part of a name such as authToken or private_key.
        self.cue = re.compile(rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{'|'.join(sorted(CUES, key=len, reverse=True))})(?![a-z])")
        self.quoted = re.compile(r"""[A-Za-z0-9_\])]["']?\s{0,3}(?:[=:]|=>|:=)\s{0,3}["'`]\Z""")
        self.user_part = re.compile(r"://[^\s/:@]{0,64}:\Z")
        # What stands nearest to the text is cheapest to refer to.
        words = zstandard.ZstdCompressionDict(PRIMER.encode() + b" " + dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, window_log=17, hash_log=15, chain_log=6, search_log=1, write_content_size=False
        )  # the fast strategy with a target length leaves literals as they are
        self.zstd = zstandard.ZstdCompressor(dict_data=words, compression_params=plain)

    def base(self, text: str, low: str) -> list[Span]:
        found: list[Span] = []
        if any(cue in low for cue in ASSIGN_CUES):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(1) - m.start(1) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def added_bytes(self, context: str, candidate: str) -> int:
        """Compressed bytes that the candidate adds to the text around it, after the dictionary."""
        before = context.encode("utf-8", "replace")
        both = before + candidate.encode("utf-8", "replace")
        return len(self.zstd.compress(both + TAIL)) - len(self.zstd.compress(before + TAIL))

    def plausible(self, word: str) -> bool:
        if len(re.findall(r"[A-Za-z]", word)) < 3:  # dates, numbers
            return False
        return bool(re.search(r"\d", word) or (re.search(r"[a-z]", word) and re.search(r"[A-Za-z][A-Z]", word)))

    def around(self, text: str, s: int, e: int) -> str:
        """The text on both sides without other occurrences of the candidate, whole ones or those cut by the window:
        a secret that stands twice is no less novel, and each of its places is judged as if it were the only one."""
        n, word = self.novelty.around, text[s:e]
        wide = 2 * (n + e - s)
        left, right = text[max(0, s - wide) : s].replace(word, ""), text[e : e + wide].replace(word, "")
        for k in range(len(word) - 1, 3, -1):
            if left.startswith(word[-k:]):
                left = left[k:]
            if right.endswith(word[:k]):
                right = right[:-k]
        return right[:n] + "\n" + left[-n:]

    def novel(self, text: str) -> list[Span]:
        n, found, cues, starts, last = self.novelty, [], None, [], -1
        for m in self.candidate.finditer(text):
            s, e = m.span()
            word = m[0]
            if not self.plausible(word):
                continue
            if cues is None:
                cues = [c.span() for c in self.cue.finditer(text)]
                starts = [c[0] for c in cues]
            i = bisect_right(starts, e + n.near) - 1
            head = text[max(0, s - 80) : s]
            if text[e : e + 1] == "@":  # before a host: a URL's password, or the name of a mailbox
                sensitive = self.user_part.search(head)
            elif head[-1:] == "@":  # a host
                sensitive = False
            else:
                cued = i >= 0 and cues[i][1] >= s - n.near
                sensitive = cued or word.startswith(PREFIXES) or self.quoted.search(head) or (last >= 0 and s - last <= 4)
            if not sensitive:
                continue
            if self.added_bytes(self.around(text, s, e), word) >= n.share * (e - s):
                found.append((s, 3, e))
                last = e
        return found

    def scan(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans and novel spans, each by start."""
        if not text:
            return [], []
        return self.base(text, text.lower()), self.novel(text)


#: What no word of the dictionary may come from: base matches, and whole runs that could be candidates (with a digit or letters of
#: both cases). A run is looked at once, from its start, so that long ones take linear time.
BASE = rf"{ASSIGN}|AKIA[A-Z0-9]+|[0-9a-f]{{32,}}"
RUN = r"(?<![A-Za-z0-9+/_=~.-])(?=[A-Za-z0-9+/_=~.-]*?(?:[0-9]|[A-Za-z][A-Z]))[A-Za-z0-9+/_=~.-]{8,}"


def letter_pairs(word: str) -> list[str]:
    return [word.lower()[i : i + 2] for i in range(len(word) - 1)]


def pair_counts(words: dict[str, int]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w, n in words.items():
        for pair in letter_pairs(w):
            counts[pair] = counts.get(pair, 0) + n
    return counts


def speakable(words: dict[str, int], share: float = 2 / 3, counts: dict[str, int] | None = None) -> list[str]:
    """The words most of whose letter pairs are common ones, that is, no rarer among all words' pairs, by how often the words occur,
    than they would be in random letters. Random letters have about a third of common pairs, words of a language nine tenths.
    All words are `words`, or those that `counts` were made of."""
    counts = pair_counts(words) if counts is None else counts
    least = sum(counts.values()) / 26**2
    pairs = {w: letter_pairs(w) for w in words}
    return [w for w in words if sum(counts.get(p, 0) >= least for p in pairs[w]) >= share * len(pairs[w])]


def corpus_words(docs: DataFrame, most: int = 2_000, text: str = "text") -> bytes:
    """The corpus's own dictionary: the commonest words and identifiers of all its texts, as bytes for the compressor.

    Every document is counted; the driver gets the counts of letter pairs, 27 * 27 at most, and `most` words at any size.
    Words hold letters and _ alone and stand in 3 different texts at least; equal texts count once. So that
    a secret is no entry, nothing is taken from base matches and from runs that could be candidates, and words whose letter
    pairs are mostly rare go (see `speakable`). The commonest come last, nearest to the text. Null and empty texts give no words; without
    words the dictionary is empty.

    Texts stay where they are: copies of a text, known by its digest, weigh one together. Only if more than
    BROADCAST_ROWS texts have copies do texts meet their digests in a shuffle.
    """
    texts = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''").withColumn("digest", F.md5("text"))
    copies = materialize(texts.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"), "secret-copies")
    weighed = texts.join(small_side(copies), "digest", "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))
    # A base match becomes part of a run that is left out, with what stands beside it.
    words = F.regexp_extract_all(F.regexp_replace("text", BASE, "0" * 8), F.lit(f"{RUN}|([A-Za-z_]{{4,24}})"), F.lit(1))
    words = weighed.select(F.explode(F.array_distinct(words)).alias("word"), "weight").where("word <> ''")
    # A text's copies all hold its words, so sums of weights are whole numbers but for the last digits.
    words = words.groupBy("word").agg(F.round(F.sum("weight")).cast("long").alias("n")).where("n >= 3")
    words = materialize(words, "secret-words")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(pair_counts(dict(zip(b["word"], b["n"], strict=True))).items(), columns=["pair", "n"])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b["word"].isin(speakable(dict(zip(b["word"], b["n"], strict=True)), counts=counts))]

    counts = {r[0]: r[1] for r in words.mapInPandas(count, "pair string, n long").groupBy("pair").sum("n").collect()}
    top = words.mapInPandas(keep, words.schema).orderBy(F.desc("n"), "word").limit(most).collect()
    discard(copies, words)
    return " ".join(r["word"] for r in reversed(top)).encode()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, and each run of overlapping ones, replaced by a mark of its first kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in sorted(spans):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(novelty: Novelty, dictionary: bytes):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(novelty, dictionary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                base, novel = scanner.scan(text)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, *counts, len(novel), digest, joined(base + novel)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return scan


def find_secrets(docs: DataFrame, novelty: Novelty = Novelty()) -> DataFrame:
    """Secrets of every whole text: counts by kind, the base spans' digest and all spans.

    Base kinds are leftmost non-overlapping matches: `assign` (a value of 8 characters or more
    given to a telling name), `access` (AKIA and 12 more), `hex` (32 or more). `novel` are strings
    in a sensitive context whose marginal bytes under zstandard, primed with a dictionary of code words
    and of the corpus's own words and with the text on both sides, say that they can't be compressed;
    they may lie in base spans, then the method confirms those. Spans are kind:start:end in code points,
    whole matches. Texts are read three times, for their digests, for the dictionary's counts and for the scan; only digests and
    counts of words are shuffled (see `corpus_words`).

    Null and empty texts have no spans; null ids stay null; repeated rows are scanned each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInPandas(_scan(novelty, corpus_words(rows)), SCHEMA)


def redact_secrets(docs: DataFrame, novelty: Novelty = Novelty(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced by marks, and n_chars (if there) counted anew.

    Null and empty texts and all rows without secrets stay as they are, repeated ones and those of null
    ids too; an empty table gives an empty one. No helper column is added.
    """
    dictionary = corpus_words(docs, text=text)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        scanner = Scanner(novelty, dictionary)
        out = []
        for t in texts:
            base, novel = scanner.scan(t)
            out.append(redact(t, base + novel) if base or novel else t)
        return pd.Series(out, dtype=object)

    out = small_batches(docs).withColumn(text, clean(F.col(text)))
    return out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
