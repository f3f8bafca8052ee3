"""Winnowing fingerprints of documents, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import let, materialize, with_position

GRAM = 3  # words hashed together
SPAN = 8  # grams of a window: any match of GRAM + SPAN - 1 words is found
TOKEN = r"[^\x20\x09-\x0D]{1,16}"  # a word; long runs, as of scripts without spaces, are cut
LOW32 = (1 << 32) - 1


#: Grams are polynomials of their words' hashes at BASE, modulo the prime 2**31 - 1, so that products fit a long.
PRIME, BASE = (1 << 31) - 1, 1_000_003


def _packed(h: Column, at: Column) -> Column:
    """31 bits of hash over the position counted down: the least one has the rightmost tie."""
    return F.shiftleft(h, 32).bitwiseOR(F.lit(LOW32) - at.cast("long"))


def _from(values: Column, start: int, n: Column) -> Column:
    """n values from a place, counted from 0."""
    return F.slice(values, F.lit(start + 1), n)


def _rolled(words: Column, k: int) -> Column:
    """Hash of every run of k words, k <= n: all runs are rolled on by a word at a time, (hash * BASE + next word) modulo PRIME."""
    if k == 1:
        return words
    more = lambda h: F.zip_with(_from(h, 0, F.size(words) - (k - 1)), _from(words, k - 1, F.size(words) - (k - 1)), lambda x, y: (x * BASE + y) % PRIME)
    return let(_rolled(words, k - 1), more)


def _grams(tokens: Column, k: int) -> Column:
    """Packed hashes of a text's grams; each word is hashed once, whatever the number of grams that it is in."""
    words = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))

    def grams(h: Column) -> Column:
        whole = F.array(_packed(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: (acc * BASE + x) % PRIME), F.lit(0)))
        run = F.transform(_rolled(h, k), _packed)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, whole).otherwise(run)

    return let(words, grams)


def _beside(values: Column, shift: int) -> Column:
    """The lesser of each value and the one `shift` after it."""
    n = F.size(values) - shift
    return F.zip_with(_from(values, 0, n), _from(values, shift, n), lambda x, y: F.least(x, y))


def _halved(values: Column, shift: int) -> Column:
    return let(values, lambda v: _beside(v, shift))


def _least(values: Column, w: int) -> Column:
    """The least of every w values in a row, w <= n, by doubling: of 2, of 4 and so on, and at last of two runs that overlap."""
    width, out = 1, values
    while width < w:
        shift = min(width, w - width)
        out = _halved(out, shift)
        width += shift
    return out


def _chosen(grams: Column, w: int) -> Column:
    n = F.size(grams)
    return F.when(n == 0, grams).when(n <= w, F.array(F.array_min(grams))).otherwise(F.array_distinct(_least(grams, w)))


def winnow(text: Column, k: int = GRAM, w: int = SPAN) -> Column:
    """array<long> of chosen grams: hash << 32 | (2**32 - 1 - position), in order of position.

    Of every w grams in a row the least hash is chosen, of ties the rightmost. A text of fewer
    than k words is one gram, of fewer than w grams one window; without words it is empty.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: let(_grams(t, k), lambda g: _chosen(g, w)))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32).cast("int")))


def rendered(chosen: Column) -> Column:
    """`hash:position` of every chosen gram, comma-joined."""
    return F.array_join(
        F.transform(
            chosen,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(LOW32) - x.bitwiseAND(F.lit(LOW32))).cast("string")
            ),
        ),
        ",",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike, 1."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b)
    return F.when(every == 0, 1.0).otherwise(let(both, lambda c: c / (every - c)))


def with_previous(ids: DataFrame) -> DataFrame:
    """(doc_id, pred_id, pred_n) of distinct (doc_id, n): who comes before each, the last before the first.

    Ids are laid out in sorted ranges and met by position, so ids may lie close or be spread over
    all of 64 bits, and no window takes all documents.
    """
    placed, total = with_position(ids, [F.col("doc_id")], "winnow-order")
    after = F.pmod(F.col("_pos") + 1, F.lit(max(1, total)))
    before = placed.select(after.alias("_pos"), F.col("doc_id").alias("pred_id"), F.col("n").alias("pred_n"))
    return placed.join(before, "_pos").select("doc_id", "pred_id", "pred_n")


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = SPAN) -> DataFrame:
    """Fingerprint, as rendered(), of each whole text: (doc_id, fingerprint)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", rendered(winnow(text, k, w)).alias("fingerprint"))


def edit_trial(docs: DataFrame, k: int = GRAM, w: int = SPAN) -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike they are.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the next
    document by doc_id (after the last: the first). Only those code points and the next
    fingerprint's hashes travel, to a document's place by its id.

    A null text is empty. Rows that repeat an id: of the following document's rows the one of the
    least prefix is taken. A null id has no next document: nothing replaces its end, and
    near_next compares with an empty fingerprint. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lengths = materialize(docs.select("doc_id", F.char_length("text").cast("long").alias("n")), "winnow-lengths")
    ids = lengths.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    ids = materialize(ids, "winnow-ids")
    order = materialize(with_previous(ids.select("doc_id", "n")), "winnow-order")

    # Both joins deal the same rows by the same key, so Spark shuffles the texts once; grams are chosen after that.
    named = docs.where("doc_id IS NOT NULL")
    given = named.join(order.hint("shuffle_hash"), "doc_id")
    given = given.select(
        F.col("pred_id").alias("doc_id"),
        F.expr("left(text, int(pred_n div 4))").alias("_prefix"),
        hashes(winnow(F.col("text"), k, w)).alias("_next"),
    )
    if ids.where("rows > 1").limit(1).count():
        given = given.groupBy("doc_id").agg(F.min(F.struct("_prefix", "_next")).alias("_g")).select("doc_id", "_g.*")

    rows = named.join(given, "doc_id", "left")
    if lengths.where("doc_id IS NULL").limit(1).count():
        nobody = docs.where("doc_id IS NULL")
        rows = rows.unionByName(nobody, allowMissingColumns=True)
    rows = rows.withColumns({"n_chars": F.char_length("text").cast("long"), "_a": winnow(F.col("text"), k, w)})
    rows = rows.withColumn("_q", F.expr("int(n_chars div 4)"))
    edited = F.expr("concat(left(text, int(n_chars) - _q), left(coalesce(_prefix, ''), _q))")
    rows = rows.select("doc_id", "n_chars", "_a", "_next", edited.alias("_edited"))
    rows = rows.withColumn("_b", winnow(F.col("_edited"), k, w))
    rows = rows.withColumns({"_ha": hashes(F.col("_a")), "_hb": hashes(F.col("_b"))})
    after = F.coalesce(F.col("_next"), F.array().cast("array<int>"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        rendered(F.col("_a")).alias("fingerprint"),
        rendered(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_ha"), F.col("_hb")).cast("double").alias("near_edited"),
        likeness(F.col("_ha"), after).cast("double").alias("near_next"),
    )
