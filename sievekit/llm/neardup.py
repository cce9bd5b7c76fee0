"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts become sets of five-word shingles, held as 64-bit hashes. Texts with
equal sets form one class; everything after that works on classes, so a group
of exact copies of any size costs one row. A class is named by half of a 128-bit
digest of its set; where sets with other digests share that half, the whole
digest names them.

1. Banded MinHash: two classes are candidates where all ROWS minima of one of
   BANDS bands agree. At similarity 0.75 a pair is missed with probability
   (1 - 0.75**ROWS)**BANDS, about 2e-6.
2. Candidates are compared by batches of 8-bit minima. After each batch the
   posterior of their similarity (uniform prior) decides: pairs whose chance of
   reaching the threshold is below MISS are dropped.
3. Survivors are confirmed on their full sets.

A bucket of m members isn't expanded into its m*m pairs. In the first round,
each member is compared with its bucket's pivot, drawn by hash, and only its
most similar pivots go on to the full sets. Confirmed links join classes into
provisional components. In the second round, each bucket that still holds
several components yields the pairs between them, and only those: pairs inside
one component can't change the result. Buckets of more than LARGE members don't
yield rows for pairs: blocks of members and of those outside the bucket's main
component meet in units of bounded size, where the same comparison runs on
arrays, pairs that meet in an earlier bucket are left to it, and one link to each
component comes out. So every candidate pair is either examined or already known
to be connected.

Edge cases: a text without words (or null) has no set, n_shingles 0, and is
its own component; a text of fewer than five words has its whole sequence as
its one shingle; repeated rows have equal sets and so share a component, whose
id is the smallest doc_id, and all rows with that doc_id are kept; null doc_ids
count only where a whole component has no other, which then is kept as it is;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, dealt_anew, forget, map_batches, placed, read, release, stored, word_slices
from .components import components

SHINGLE = 5
SIMILAR, OF = 75, 100
BANDS, ROWS = 48, 5
HASHES = BANDS * ROWS
#: Minima compared before each decision.
BATCH = 24
#: Chance at which a pair that reaches the threshold may be dropped unseen.
MISS = 1e-6
#: Pivots of a class that the first round confirms on full sets; the second round takes what is left.
FIRST = 2
#: Orders from which the pivots of a group's bands come.
ORDERS = 12
#: Parts in which a component's classes are joined with its smallest id.
SALTS = 16
#: Members of a bucket from which it is worked through in units, and members and outsiders of a unit.
LARGE, UNIT_MEMBERS, UNIT_OUTSIDERS = 64, 1024, 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text, given the hashes of its words."""
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, SHINGLE)
    mixed = h[: n - width + 1] * _ODD[0] + np.uint64(width)
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[k] + h[k : n - width + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _ODD[4])


def _digest(shingles: bytes) -> tuple[int | None, int | None]:
    """Both halves of the digest of a set."""
    if not shingles:
        return None, None
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles), 2**64)
    return low - 2**63, high - 2**63


def apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """Names sets by their whole digest where the half in `node` is one of clashes, which have been counted to be few."""
    known = clashes.select(F.col("node").alias("__node"))
    rows = rows.join(known, F.col("node") == F.col("__node"), "left")
    return rows.withColumn("node", F.when(F.col("__node").isNull(), F.col("node")).otherwise(F.xxhash64("node", "other"))).drop("__node")


def minhash_parameters() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    odd = (draw.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return odd[:, None], draw.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit minima of a non-empty set, in blocks that stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    low = None
    for at in range(0, x.shape[1], 1024):
        block = (a * x[:, at : at + 1024] + b).min(axis=1)
        low = block if low is None else np.minimum(low, block)
    return low


def fewest_matches() -> list[tuple[int, int]]:
    """(minima compared, fewest matches with which a pair stays), by the posterior of the similarity under a uniform prior."""
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 256  # 8-bit minima also agree by chance
    limits = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for k in range(n + 1):
            log = k * np.log(agree) + (n - k) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= SIMILAR / OF].sum() / weight.sum() >= MISS:
                break
        limits.append((n, k))
    return limits


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, other, bands, minima): node and other are the halves of the set's digest, null for an empty one."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        a, b = minhash_parameters()
        for batch in batches:
            n, digests, bands, minima = [], [], [], []
            for words in word_slices(batch[text], SPACED):
                s = shingle_set(words)
                n.append(len(s))
                digests.append(_digest(s.tobytes()))
                if not len(s):
                    bands.append(None), minima.append(None)
                    continue
                low = signature(s, a, b)
                parts = low.reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(p.tobytes(), i) - 2**63 for i, p in enumerate(parts)])
                minima.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            yield {"doc_id": batch["doc_id"], "n_shingles": pa.array(n, pa.int64()), "node": [d[0] for d in digests], "other": [d[1] for d in digests], "bands": bands, "minima": minima}

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, n_shingles bigint, node bigint, other bigint, bands array<bigint>, minima binary")


def full_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, other, shingles): the sets, as 64-bit numbers in binary, and the halves of their digests."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(words).tobytes() for words in word_slices(batch[text], SPACED)]
            digests = [_digest(s) for s in sets]
            yield {"node": [d[0] for d in digests], "other": [d[1] for d in digests], "shingles": sets}

    return map_batches(docs.select(text), run, "node bigint, other bigint, shingles binary")


def short_sets(sets: DataFrame) -> DataFrame:
    """(node, size, short): the upper halves of the hashes, enough to rule out pairs inside a unit."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            full = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["shingles"]]
            yield {"node": b["node"], "size": [len(x) for x in full], "short": [np.sort(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in full]}

    return map_batches(sets.select("node", "shingles"), run, "node bigint, size int, short binary")


def _surviving(one: np.ndarray, many: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows of minima in `many` that sequential comparison with `one` doesn't rule out."""
    alive, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for n, fewest in limits:
        matches = matches + (many[alive, n - BATCH : n] == one[n - BATCH : n]).sum(axis=1)
        stays = matches >= fewest
        alive, matches = alive[stays], matches[stays]
    return alive


def in_units(big: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): for members of large buckets, probable links between components, one for each u and component of v.

    big: key, node, root, main (the bucket's main component), n members and o
    of them outside main. Counts on 32-bit halves may be a little off through
    collisions, so pairs two shingles short still come out; confirmed() decides.
    """
    every = big.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most one a band
    shorts = short_sets(sets.join(every.select("node"), "node", "left_semi"))
    rows = big.join(every.join(nodes.select("node", "minima"), "node").join(shorts, "node"), "node")  # each node's columns first, once
    blocks, outside = F.ceil(F.col("n") / UNIT_MEMBERS).cast("int"), F.ceil(F.col("o") / UNIT_OUTSIDERS).cast("int")
    own = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    every_of = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    members = rows.withColumn("i", own(blocks)).withColumn("j", every_of(outside)).withColumn("outer", F.lit(False))
    outsiders = rows.where("root <> main").withColumn("j", own(outside)).withColumn("i", every_of(blocks)).withColumn("outer", F.lit(True))
    columns = ["key", "i", "j", "outer", "node", "root", "main", "keys", "minima", "size", "short"]
    limits = fewest_matches()

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs = rows[rows["outer"]], rows[~rows["outer"]]
        found: list[tuple[int, int]] = []
        if len(us) and len(vs):
            key = rows["key"].iloc[0]
            minima = np.frombuffer(b"".join(vs["minima"]), np.uint8).reshape(-1, HASHES)
            node, root, size = (vs[c].to_numpy() for c in ("node", "root", "size"))
            free = root == vs["main"].to_numpy()
            sets = [np.frombuffer(x, np.uint32) for x in vs["short"]]
            earlier: dict[int, list[int]] = {}
            for at, keys in enumerate(vs["keys"]):
                for k in keys[: np.searchsorted(keys, key)]:
                    earlier.setdefault(int(k), []).append(at)
            for u in us.itertuples(index=False):
                open_ = (root != u.root) & (free | (node > u.node))
                for k in u.keys[: np.searchsorted(u.keys, key)]:
                    open_[earlier.get(int(k), [])] = False
                places = np.flatnonzero(open_)
                places = places[_surviving(np.frombuffer(u.minima, np.uint8), minima[places], limits)]
                if not len(places):
                    continue
                mine = np.frombuffer(u.short, np.uint32)
                lengths = np.array([len(sets[x]) for x in places])
                theirs = np.concatenate([sets[x] for x in places])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]])) + 2
                good = OF * common >= SIMILAR * (u.size + size[places] - common)
                order = np.argsort(-common[good] / (u.size + size[places][good]), kind="stable")
                best = places[good][order]
                _, firsts = np.unique(root[best], return_index=True)
                found += [(u.node, node[x]) for x in best[firsts]]
                # a pair that only seemed to reach the threshold must not hide another one
                close = good & (OF * (common - 2) < SIMILAR * (u.size + size[places] - common + 2))
                found += [(u.node, node[x]) for x in places[close]]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    both = members.select(*columns).union(outsiders.select(*columns))
    return both.groupBy("key", "i", "j").applyInPandas(unit, "u bigint, v bigint").distinct()


def likely(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """(u, v, near): the pairs that sequential comparison doesn't rule out, with their estimated similarity."""
    both = pairs.join(minima.select(F.col("node").alias("u"), F.col("minima").alias("mu")), "u").join(
        minima.select(F.col("node").alias("v"), F.col("minima").alias("mv")), "v"
    )
    limits = fewest_matches()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("mu", "mv"))
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, fewest in limits:
                matches = matches + (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                stays = matches >= fewest
                alive, matches = alive[stays], matches[stays]
            take = pa.array(alive)
            yield {"u": b["u"].take(take), "v": b["v"].take(take), "near": pa.array(matches / HASHES, pa.float64())}

    return map_batches(both.select("u", "v", "mu", "mv"), run, "u bigint, v bigint, near double")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose full sets reach the threshold, in whole numbers: OF * common >= SIMILAR * union."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v"
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            good = []
            for su, sv in zip(b["su"], b["sv"]):
                x, y = np.frombuffer(su.as_buffer(), np.uint64), np.frombuffer(sv.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(OF * common >= SIMILAR * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield {"u": b["u"].filter(keep), "v": b["v"].filter(keep)}

    return map_batches(both.select("u", "v", "su", "sv"), run, "u bigint, v bigint")


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """(node, shingles) of the wanted classes, made from one text of each.

    Documents are picked by id, and the class of a text is found again from its
    set, so ids that several texts share do no harm.
    """
    ids = nodes.join(wanted, "node").select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    sets = full_sets(texts).where("node is not null")
    return (sets if clashes is None else apart(sets, clashes)).drop("other").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; doc_id may be of any type that can be ordered."""
    docs = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    sketched = sketches = stored(sketch(docs), "sketches")
    halves = sketches.where("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    clashes = stored(halves.where("a <> b").select("node"), "clashes")
    if clashes.isEmpty():
        forget(clashes)
        clashes = None
    else:
        sketches = apart(sketches, clashes)
    classes = sketches.where("node is not null").groupBy("node")
    nodes = stored(classes.agg(F.first("bands").alias("bands"), F.first("minima").alias("minima"), F.min("doc_id").alias("doc_id")), "nodes")
    rows = stored(sketches.select("doc_id", "n_shingles", "node"), "rows")
    forget(sketched)
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # the pivot is the first in one of ORDERS hashed orders, so that a group has some pivots, but not another in each band
    drawn = F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(ORDERS)), "node").alias("h"), "node"))["node"]
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), drawn.alias("pivot")).where("n > 1").drop("n")
    members = stored(keyed.join(dealt_anew(shared, "key"), "key"), "members")
    release(docs.sparkSession)
    sets = stored(_sets_of(docs, nodes, members.select("node").distinct(), clashes), "sets")
    release(docs.sparkSession)

    star = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    nearest = Window.partitionBy("u").orderBy(F.desc("near"), "v")  # at most one row a band
    first = likely(star, nodes).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= FIRST)
    roots = components(confirmed(first.select("u", "v"), sets))

    pivots = roots.select(F.col("node").alias("pivot"), F.col("root").alias("main"))
    label = members.join(roots, "node", "left").join(pivots, "pivot", "left")
    label = label.select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("main", "pivot").alias("main"))
    several = label.groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n"), F.sum((F.col("root") != F.col("main")).cast("int")).alias("o")
    )
    mixed = stored(label.join(dealt_anew(several.where("a <> b").drop("a", "b"), "key"), "key"), "mixed")
    small = mixed.where(F.col("n") <= LARGE)
    outside = small.where("root <> main").select("key", F.col("node").alias("u"), F.col("root").alias("ru"))
    inside = small.select("key", F.col("node").alias("v"), F.col("root").alias("rv"), "main")
    across = outside.join(inside, "key").where("ru <> rv and (rv = main or u < v)")
    rest = across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    probable = likely(rest, nodes).select("u", "v").union(in_units(mixed.where(F.col("n") > LARGE), nodes, sets))
    links = confirmed(probable, sets)

    # the links of the second round join components of the first: only the components' ids go through star contraction again
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = links.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left")
    tops = components(between.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    above = dealt_anew(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
    joined = stored(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(tops), "joined")
    forget(tops)
    forget(members, mixed, sets, roots)
    release(docs.sparkSession)
    # classes that have links; a component may hold most of them, so they meet its smallest id in SALTS parts
    roots = joined.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    linked = nodes.select("node", "doc_id").join(joined.union(roots), "node")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(least, ["root", "salt"]).select("node", "component_id")
    # a table of its own, so that the last join deals out both sides anew and a class of many copies can be split
    ids = nodes.select("node", "doc_id").join(found, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    ids = stored(ids, "ids")
    forget(nodes, joined)
    rows = rows.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs less those that a near-duplicate group has besides its first one, with the same columns.

    Rows are told apart by their places in the files, never by their ids: the
    first row of a group is that with the smallest doc_id, a null one counting
    as the largest, and of several with that id the first by file (hashed) and
    row. Rows without words are in no group and all stay.
    """
    docs = placed(docs, "__place")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__place")
    kept = near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text"))).where("kept")
    return docs.join(kept.select(F.col("doc_id.__place").alias("__place")), "__place", "left_semi").drop("__place").select(*[c for c in docs.columns if c != "__place"])


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents
),
shingles as (
  select distinct doc_id, g from (
    select doc_id, list_slice(w, i, i + 4) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from words where len(w) > 0)
  )
),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
pairs as (select a.doc_id u, b.doc_id v, count(*) c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)
),
reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.v from reach r join links l on l.u = r.other
),
comp as (select doc_id, min(other) component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) n_shingles, component_id, d.doc_id = component_id as kept
from documents d join comp c on c.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""

QUERIES = {"op3_minhash_neardup": op3_minhash_neardup}
ORACLES = {"op3_minhash_neardup": OP3_SQL}
