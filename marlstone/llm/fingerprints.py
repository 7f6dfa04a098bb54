"""I-Match document fingerprints, in DataFrame functions only.

A document's terms are those of its distinct words whose inverse document frequency lies in a band. Each of `PARTS`
randomised lexicons is a fixed family of nested subsets of the corpus's terms: a term's rank under the lexicon is a
hash, and the subsets are the ranks below 2^31, 2^30 and so on. A part takes the smallest of its subsets that still
meets the document, sorts the terms found there and hashes them. So every part has some terms, of a short document as
of a long one, and few enough of them to outlive an edit; hashed under one subset of fixed share instead, a text whose
last third is replaced has hardly an equal part (see the README). Equal texts have equal parts; the likeness of two
fingerprints is the share of equal parts.

Document frequencies are counted by term, exactly. The terms in the band, at most 1 / BAND[0] times the mean number of
distinct words of a document however large the corpus, are laid out in a table that is a constant of the plan: each
term stands at one of two places that its ranks under two more lexicons choose, so two looks tell whether a word is a
term, and no other word is taken for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import set_aside, stored

PARTS = 16
#: Places of each half of the table for each term in it.
ROOM = 1.2
#: Shares of all documents between which a term's document frequency must lie.
BAND = (2.0**-11, 2.0**-4)
#: Ranks are residues of this prime.
PRIME = (1 << 31) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _factors(k: int) -> tuple[int, int]:
    """Of lexicon k: a term t has the rank (t * first + second) mod PRIME."""
    return 48271 ** (k + 1) % PRIME, 69621 ** (k + 1) % PRIME


def word_hashes(text: Column) -> Column:
    """52-bit hashes of the distinct lower-cased (A-Z) words: letters, digits and whatever isn't ASCII."""
    words = F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.transform(F.array_distinct(F.array_remove(words, "")), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 13), 16, 10).cast("long"))


def _rank(term: Column, k: int) -> Column:
    first, second = _factors(k)
    return (term % PRIME * first + second) % PRIME


def table_of(terms: list[int], number: int = PARTS) -> list[int]:
    """Two halves, each with a place that a term's rank under lexicon `number`, or the next one, chooses; -1 is free.
    A term goes to its place in the first half and moves who stands there to the other half, and so on."""
    half, order = int(len(terms) * ROOM) + 1, sorted(terms)
    while True:
        table = [-1] * (2 * half)
        for term in order:
            side, moves = 0, 0
            while term >= 0 and moves < 500:
                first, second = _factors(number + side)
                place = side * half + (term % PRIME * first + second) % PRIME % half
                table[place], term = term, table[place]
                side, moves = 1 - side, moves + 1
            if term >= 0:  # in a circle: with other places all of them find one
                half += half // 8 + 1
                break
        else:
            return table


class Lexicon:
    """The band's terms as a constant of the plan."""

    def __init__(self, terms: list[int]):
        table = table_of(terms)
        self.half = len(table) // 2
        self.table = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def has(self, term: Column) -> Column:
        places = F.array(*((_rank(term, PARTS + side) % self.half + side * self.half + 1).cast("int") for side in (0, 1)))
        return F.exists(places, lambda place: F.element_at(self.table, place) == term)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Lexicon:
    total = docs.count()
    terms = docs.select(F.explode(word_hashes(F.coalesce("text", F.lit("")))).alias("term"))
    inside = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(band[0] * total, band[1] * total))
    return Lexicon([r.term for r in inside.select("term").toLocalIterator()])


def parts(hashes: Column) -> Column:
    """The hashes of a set of terms under each lexicon, of 32 bits, less 2^31."""

    def part(factors: Column) -> Column:
        ranks = F.transform(hashes, lambda t: (t % PRIME * factors["a"] + factors["b"]) % PRIME)
        # A transform over an array of one value names it: ranks and bound are worked out once, not for each element.
        bound = lambda x: F.pow(F.lit(2.0), F.length(F.bin(F.array_min(x)))).cast("long")
        below = lambda x: F.transform(F.array(bound(x)), lambda b: F.filter(x, lambda r: r < b))[0]
        found = F.array_sort(F.transform(F.array(ranks), below)[0])
        digits = F.substring(F.md5(F.array_join(found.cast("array<string>"), ",").cast("binary")), 1, 8)
        return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 31)).cast("int")

    pairs = [F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in map(_factors, range(PARTS))]
    return F.transform(F.array(*pairs), part)


def likeness(a: Column, b: Column, number: int = PARTS) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(float(number))


def _shown(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda p: F.lower(F.lpad(F.hex(p.cast("long") + F.lit(1 << 31)), 8, "0"))), "-")


def with_parts(df: DataFrame, band: Lexicon, texts: dict[str, str]) -> DataFrame:
    """Adds the parts of the fingerprints of columns of text, each by the name in `texts`; a text without terms in the
    band uses all its words. The table of the band stands in the plan once."""
    some = lambda words: F.transform(F.array(F.filter(words, band.has)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(words))[0]
    found = df.withColumn("__words", F.transform(F.array(*map(F.col, texts)), word_hashes)).withColumn("__words", F.transform("__words", some))
    found = found.withColumn("__words", F.transform("__words", parts))
    return found.withColumns({name: F.col("__words")[k] for k, name in enumerate(texts.values())}).drop("__words")


def fingerprint(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """`docs` with `fingerprint`; a column of that name is replaced, a null text is empty, other columns stay."""
    aside, back = set_aside(docs.drop("fingerprint"), ("__text", "__parts", "__words"))
    filled = aside.withColumn("__text", F.coalesce("text", F.lit("")))
    return with_parts(filled, lexicon(docs, band), {"__text": "__parts"}).select(*back, _shown(F.col("__parts")).alias("fingerprint"))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, need, next_id) for each distinct doc_id, null the lowest: the id that follows in descending order,
    after the last the first; need: a third of the id's longest text. Ids are sorted in ranges; what one range
    hands to the one before it is a row for each range."""
    ids = docs.groupBy("doc_id").agg(F.floor(F.max(F.length(F.coalesce("text", F.lit("")))) / 3).cast("int").alias("need"))
    ranges = stored(ids.repartitionByRange(F.desc_nulls_last("doc_id")).withColumn("range", F.spark_partition_id()))
    inside = F.lead("doc_id").over(W.partitionBy("range").orderBy(F.desc_nulls_last("doc_id")))
    place = F.row_number().over(W.partitionBy("range").orderBy(F.asc_nulls_first("doc_id")))
    linked = ranges.select("*", inside.alias("lead"), place.alias("place"))
    heads = ranges.groupBy("range").agg(F.max("doc_id").alias("head"))
    around = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("range", F.lead("head", 1).over(W.orderBy("range")).alias("following"), F.lead(F.lit(True), 1, False).over(W.orderBy("range")).alias("more"), F.first("head").over(around).alias("first_head"))
    end = F.when(F.col("more"), F.col("following")).otherwise(F.col("first_head"))
    return linked.join(F.broadcast(heads), "range").select("doc_id", "need", F.when(F.col("place") == 1, end).otherwise(F.col("lead")).alias("next_id"))


def fingerprint_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text, of its edited form and how like they are; see the contract in the README.

    A null text is empty. Rows with the same doc_id (null counts as one, the lowest) follow one another as one
    document: the next document of each is the one with the next lower id, and where that id repeats, the row whose
    text has the greatest hash. A single document follows itself. An empty table gives no rows; other columns
    aren't read. Each text is shuffled once, and a third of it once more.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms, links = lexicon(docs, band), stored(successors(docs))
    chosen = F.xxhash64("text")
    owners = links.select(F.col("doc_id").alias("owner"), "need", F.col("next_id").alias("__next"))
    heads = (
        docs.join(owners, F.col("doc_id").eqNullSafe(F.col("__next")))
        .groupBy("owner")
        .agg(F.max(F.struct(chosen.alias("chosen"), F.col("text").substr(F.lit(1), F.col("need")).alias("head"))).alias("following"))
    )
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("following.head").substr(F.lit(1), cut))
    rows = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", "text", edited.alias("edited"), chosen.alias("chosen"))
    rows = with_parts(rows, terms, {"text": "own", "edited": "changed"})
    rows = stored(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha256"), "own", "changed", "chosen"))
    by_id = rows.groupBy("doc_id").agg(F.max(F.struct("chosen", "own")).alias("one"))
    following = owners.join(by_id, F.col("doc_id").eqNullSafe(F.col("__next"))).select("owner", F.col("one.own").alias("next_own"))
    return rows.join(following, F.col("doc_id").eqNullSafe(F.col("owner"))).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha256")).alias("edited_sha256"),
        _shown(F.col("own")).alias("fingerprint"),
        _shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


#: DuckDB SQL for the rows of `fingerprint_edits(documents)` where doc_ids are distinct and none is null.
EDITS_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
followed AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM doc WINDOW w AS (ORDER BY doc_id DESC)),
edited AS (SELECT doc_id, n, next_id, text, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM followed),
texts AS (SELECT doc_id, 'own' AS kind, text AS x FROM edited UNION ALL SELECT doc_id, 'edited', edited FROM edited),
words AS (SELECT DISTINCT doc_id, kind, unnest(regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
terms AS (SELECT doc_id, kind, ('0x' || substr(md5(word), 1, 13))::BIGINT AS term FROM words),
band AS (SELECT term FROM terms WHERE kind = 'own' GROUP BY term HAVING count(*) BETWEEN {BAND[0]!r} * (SELECT count(*) FROM doc) AND {BAND[1]!r} * (SELECT count(*) FROM doc)),
marked AS (SELECT doc_id, kind, terms.term, band.term IS NOT NULL AS inside, bool_or(band.term IS NOT NULL) OVER (PARTITION BY doc_id, kind) AS any_inside FROM terms LEFT JOIN band ON terms.term = band.term),
factor(k, a, b) AS (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(map(_factors, range(PARTS))))}),
ranks AS (SELECT doc_id, kind, k, (term % {PRIME} * a + b) % {PRIME} AS r FROM marked, factor WHERE inside OR NOT any_inside),
below AS (SELECT doc_id, kind, k, r FROM ranks JOIN (SELECT doc_id, kind, k, 1::BIGINT << length(bin(min(r))) AS bound FROM ranks GROUP BY ALL) USING (doc_id, kind, k) WHERE r < bound),
hashed AS (SELECT doc_id, kind, k, substr(md5(string_agg(r, ',' ORDER BY r)), 1, 8) AS part FROM below GROUP BY ALL),
part AS (SELECT doc_id, kind, list(coalesce(part, substr(md5(''), 1, 8)) ORDER BY k) AS parts FROM texts CROSS JOIN factor LEFT JOIN hashed USING (doc_id, kind, k) GROUP BY ALL)
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o.parts, '-') AS fingerprint, array_to_string(c.parts, '-') AS edited_fingerprint,
       len(list_filter(list_zip(o.parts, c.parts), lambda x: x[1] = x[2])) / {float(PARTS)!r} AS near_edited, len(list_filter(list_zip(o.parts, f.parts), lambda x: x[1] = x[2])) / {float(PARTS)!r} AS near_next
FROM edited e JOIN part o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN part c ON c.doc_id = e.doc_id AND c.kind = 'edited' JOIN part f ON f.doc_id = next_id AND f.kind = 'own'
"""
