"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles. Two sets with Jaccard
similarity 0.8 or more differ in at most d = (|A| + |B|) / 9 elements. Sizes
fall into bands; in a band each set is cut by the elements' hashes into
S > d segments, and a segment's sketch is the XOR of its elements' hashes with
their count (what the bits of a wide parity sketch of the segment amount to). An
element in only one of two sets spoils one segment, so linked sets agree in at
least S - d segments. Of a set's S segment sketches, those with the most
elements come first; the first d + 1 are its keys: sets that agree in S - d
segments share one of them (pigeonhole), and sketches of empty or nearly empty
segments, which many sets share, are hardly ever keys. A set also gives keys in
the next band if that band holds sets it may be linked with. Sets with a common
key are verified (``linkage``).

Copies with equal sets are one node: tasks drop the copies they have seen, and
keys are rows of nodes, so a hot group of copies never meets in one place.

Null and empty texts have no shingles and are linked with nothing; a text of
fewer than five words (but some) has one shingle, its whole sequence. Rows that
repeat an id are nodes of their own; null ids are linked but never the smallest
of a component unless alone. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, per_text, query, sized, stored
from .linkage import DEN, NUM, linked_components, most_different, set_id, sketch
from .words import mix64, shingle_sets

_U = np.uint64
SHINGLE = 5
BAND_RATIO = 1.6


def bands(limit: int) -> list[tuple[int, int]]:
    """Size bands (lowest, highest) up to a set of ``limit`` elements."""
    out, lo = [], 1
    while lo <= limit:
        hi = max(lo, int(lo * BAND_RATIO))
        out.append((lo, hi))
        lo = hi + 1
    return out


_BANDS = bands(1 << 40)
_LOW = np.array([lo for lo, _ in _BANDS])


def band_keys(h: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of a set of hashes: its own band's, then those of bands above that
    hold sets at most den / num times as large."""
    n, out = len(h), []
    own = int(np.searchsorted(_LOW, n, side="right")) - 1
    for band in range(own, len(_BANDS)):
        lo, hi = _BANDS[band]
        if band > own and num * lo > den * n:
            break
        d = most_different(2 * hi, num, den)
        if d == 0:
            continue  # only equal sets are linked here
        segments = d + 1 + max(4, (d + 1) // 4)
        salted = mix64(h ^ _U((0x632BE59BD9B4E019 * (band + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = ((salted >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)
        count = np.bincount(at, minlength=segments).astype(_U)
        value = np.zeros(segments, dtype=_U)
        np.bitwise_xor.at(value, at, mix64(salted + _U(1)))
        key = mix64(value + mix64(np.arange(segments).astype(_U) * _U(1 << 20) + count + (_U(band) << _U(48))))
        # most elements first, then by key: an order of the sketches alone
        rank = ((_U(255) - np.minimum(count, _U(255))) << _U(56)) | (key >> _U(8))
        out.append(key[np.argpartition(rank, d)[: d + 1]])
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def set_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, s) of every set; sets that a task has already seen are left out."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for h in shingle_sets(batch.column(0).to_pylist(), SHINGLE):
                if not len(h) or (s := set_id(h)) in seen:
                    continue
                seen.add(s)
                own = band_keys(h)
                keys.append(own)
                owners.append(np.full(len(own), s, dtype=np.int64))
                if sum(map(len, keys)) > 200_000:
                    yield _rows(keys, owners)
                    keys, owners = [], []
            yield _rows(keys, owners)

    return docs.select(text_col).mapInArrow(run, "key long, s long")


def _rows(keys, owners) -> pa.RecordBatch:
    k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
    s = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(s)], names=["key", "s"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, component_id (smallest id reachable by links)
    and component (a number of the component, null without shingles) of every document."""
    def measure(texts):
        sets = list(shingle_sets(texts, SHINGLE))
        return [[len(h) for h in sets], [set_id(h) if len(h) else None for h in sets],
                [sketch(h) if len(h) else None for h in sets]]

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    measured = stored(per_text(src, "n long, s long, sketch binary", measure, "_id", "_text", ("_hash",)), "ngram-sets")
    # one row per set: where its text is, and the smallest id of its copies
    nodes = stored(measured.where("s is not null").groupBy("s").agg(
        F.min(F.struct(F.col("_id"), F.col("_hash"))).alias("at"), F.min("_id").alias("least"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch")), "ngram-nodes")

    def texts(ends: DataFrame) -> DataFrame:
        at = stored(nodes.join(ends, "s").select("s", F.col("at._id").alias("_i"), F.col("at._hash").alias("_h")), "ngram-at")
        at = sized(at, 32)  # so that only the texts asked for are shuffled
        return (src.join(at, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
                .dropDuplicates(["s"]).select("s", F.col("_text").alias("text")))

    label = linked_components(set_keys(docs, text_col), nodes, texts, "ngram", SHINGLE)
    comps = nodes.join(label, "s", "left").select("s", "least", F.coalesce("comp", "s").alias("component"))
    smallest = comps.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = comps.join(smallest, "component").select("s", "component", "component_id")
    return (measured.join(of_set, "s", "left")
            .select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "_id").alias("component_id"), "component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, of each component only one: that with the smallest id
    (then text hash). Documents without shingles all stay."""
    found = stored(jaccard_components(docs, id_col, text_col).select(
        F.col(id_col).alias("__i"), F.col("text_hash").alias("__h"), "component").where("component is not null"), "ngram-components")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("__i").isNull().alias("last"), "__i", "__h")).alias("p"))
    place = found.groupBy("component", "__i", "__h").count().join(first, "component").select(
        "__i", "__h", "count", (F.struct(F.col("__i").isNull().alias("last"), "__i", "__h") != F.col("p")).alias("gone"))
    place = stored(place.where("gone or count > 1"), "ngram-gone")
    # the input's columns travel as one struct, so that none can clash
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("i"),
                      F.xxhash64(text_col).alias("h"))
    on = F.col("i").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h"))
    some, again = place.select("__i", "__h"), place.where("not gone").select("__i", "__h")
    rest = src.join(sized(some, 24), on, "left_anti")
    # rows that repeat the id and text kept are one document: only these few are put side by side
    twice = src.join(sized(again, 24), on, "left_semi").dropDuplicates(["i", "h"])
    return rest.unionByName(twice).select("row.*")


_UP, _LOW_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_SETS = rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW_}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ov AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT x, y FROM ov JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ed AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln)"""
_SQL = f"""
WITH RECURSIVE {SQL_SETS},
rc AS (SELECT doc_id AS x, doc_id AS r FROM w UNION SELECT ed.y, rc.r FROM rc JOIN ed ON ed.x = rc.x WHERE rc.r <= ed.y),
cc AS (SELECT x, min(r) AS component_id FROM rc GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, cc.component_id
FROM w JOIN cc ON cc.x = w.doc_id LEFT JOIN sz ON sz.doc_id = w.doc_id"""


@query("op9_ngram_join", _SQL)
def op9_ngram_join(spark, sf_dir):
    """Every document's set size and component."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
