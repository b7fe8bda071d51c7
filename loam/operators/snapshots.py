"""What changed between full snapshots: Merkle digests over hash ranges of the keys.

The rows of a snapshot are hashed into leaves (hash ranges of the key), the leaves of a site form a tree with sixteen
children a node. Two consecutive snapshots are compared from the root down: only children of differing nodes are looked
at on the next level, and only rows in differing leaves are compared one by one. All rows of the snapshots are read for the
digests; those of equal leaves go no further than the join with the differing leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.scratch import stored

FANOUT_BITS = 4
#: Rows a leaf should hold; the depth of a site's tree follows from its largest snapshot.
ROWS_PER_LEAF = 8
#: Levels below the root at most; 16**6 leaves a site.
MAX_LEVELS = 6


def hex_value(md5: Column) -> Column:
    """A hash as a hexadecimal value: letter case, white space, ``0x`` and leading zeros do not count.

    Null, empty and blank hashes are unknown and give null.
    """
    bare = F.regexp_replace(F.lower(md5), r"[\s 　]+", "")
    bare = F.regexp_replace(bare, "^0x", "")
    return F.when(bare == "", None).otherwise(F.regexp_replace(bare, "^0+(?=.)", ""))


def moment(text: Column) -> Column:
    """ISO dates in either form (``T`` or a space between day and time) as comparable timestamps; unreadable: null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "T", " "))


def snapshot_state(entries: DataFrame) -> DataFrame:
    """One row per site, snapshot and file: the row with the latest fetch date.

    Rows without snapshot number, site or key cannot be placed and are left out. An unreadable fetch date is older than
    any other; of rows fetched at the same moment the one with the greater entry_id holds. Repeated rows count once.
    Output: site, snapshot_no, file_key, md5 (as ``hex_value``, null: unknown).
    """
    newest = F.struct(moment(F.col("fetch_date")).alias("at"), F.col("entry_id"))
    return (
        entries.where("snapshot_no is not null and site is not null and file_key is not null")
        .groupBy("site", "snapshot_no", "file_key")
        .agg(F.max_by(hex_value(F.col("md5")), newest).alias("md5"))
    )


def consecutive(state: DataFrame) -> DataFrame:
    """Pairs (site, prev_no, snapshot_no) of a site's consecutive snapshots, with the levels of its tree."""
    sizes = state.groupBy("site", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    by_site = Window.partitionBy("site")
    levels = F.ceil(F.log2(F.max("n").over(by_site) / F.lit(float(ROWS_PER_LEAF))) / FANOUT_BITS)
    return sizes.select(
        "site",
        "snapshot_no",
        F.lag("snapshot_no").over(by_site.orderBy("snapshot_no")).alias("prev_no"),
        F.greatest(F.lit(0), F.least(F.lit(MAX_LEVELS), levels)).cast("int").alias("levels"),
    )


def placed_rows(state: DataFrame, levels: DataFrame) -> DataFrame:
    """The rows of ``state`` with the levels of their site's tree and their leaf in it."""
    placed = state.join(levels.select("site", "snapshot_no", "levels"), ["site", "snapshot_no"])
    return placed.withColumn("leaf", leaf_of(F.col("file_key"), F.col("levels")))


def leaf_digests(state: DataFrame, levels: DataFrame) -> DataFrame:
    """Digest of each leaf: row count, and xor and sum of the rows' hashes, as ``digests_of`` the placed rows."""
    return digests_of(placed_rows(state, levels))


def digests_of(placed: DataFrame) -> DataFrame:
    """Digest of each leaf of placed rows.

    Output: site, snapshot_no, levels, leaf, rows, x, s. An unknown md5 has a hash of its own.
    """
    row = F.xxhash64("file_key", F.coalesce("md5", F.lit("?")))
    return placed.groupBy("site", "snapshot_no", "levels", "leaf").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(row).alias("x"),
        F.sum(row.cast("decimal(20,0)")).alias("s"),
    )


def leaf_of(key: Column, levels: Column) -> Column:
    """The leaf of a key: the top ``4 * levels`` bits of a 24-bit hash range number."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << FANOUT_BITS * MAX_LEVELS))
    return F.floor(slot / F.pow(F.lit(float(1 << FANOUT_BITS)), F.lit(MAX_LEVELS) - levels)).cast("long")


def differing_leaves(digests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leaves whose digests differ between a pair's snapshots, found from the root down.

    Output: site, prev_no, snapshot_no, leaf.
    """
    pairs = pairs.where("prev_no is not null")
    deepest = digests.agg(F.max("levels")).first()[0] or 0

    def nodes(level: int) -> DataFrame:
        """Digests of the nodes at ``level``; trees that end above it are not among them."""
        up = F.pow(F.lit(float(1 << FANOUT_BITS)), F.col("levels") - level)
        return (
            digests.where(F.col("levels") >= level)
            .withColumn("node", F.floor(F.col("leaf") / up).cast("long"))
            .groupBy("site", "snapshot_no", "levels", "node")
            .agg(F.sum("rows").alias("rows"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"))
        )

    open_nodes, found = pairs.select("site", "prev_no", "snapshot_no", "levels", F.lit(0).cast("long").alias("node")), []
    for level in range(deepest + 1):
        here = nodes(level)
        if level:
            open_nodes = open_nodes.where(F.col("levels") >= level).withColumn(
                "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << FANOUT_BITS) - 1)), lambda c: F.col("node") * (1 << FANOUT_BITS) + c))
            )
        digest = F.struct("rows", "x", "s")
        now = here.select("site", "snapshot_no", "node", digest.alias("now"))
        then = here.select("site", F.col("snapshot_no").alias("prev_no"), "node", digest.alias("then"))
        open_nodes = (
            open_nodes.join(now, ["site", "snapshot_no", "node"], "left")
            .join(then, ["site", "prev_no", "node"], "left")
            .where(~F.col("now").eqNullSafe(F.col("then")))
            .select("site", "prev_no", "snapshot_no", "levels", "node")
        )
        found.append(open_nodes.where(F.col("levels") == level).select("site", "prev_no", "snapshot_no", F.col("node").alias("leaf")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def snapshot_changes(entries: DataFrame) -> DataFrame:
    """Files added, removed and changed between each site's consecutive snapshots.

    A snapshot is compared with the last earlier one in which the site has any row; a site's first snapshot gives
    nothing. ``changed`` needs two known hashes that differ as hexadecimal values. Columns besides entry_id,
    snapshot_no, site, file_key, md5 and fetch_date are ignored. An empty table gives no rows.
    Output: site, snapshot_no (the later one), file_key, change_kind.
    """
    state = stored(snapshot_state(entries), "snapshot-state")
    pairs = stored(consecutive(state), "snapshot-pairs")
    placed = stored(placed_rows(state, pairs), "snapshot-leaves")
    digests = stored(digests_of(placed), "snapshot-digests")
    leaves = stored(differing_leaves(digests, pairs), "snapshot-differing")
    # each differing leaf is wanted from two snapshots: of the later one what is, of the earlier one what was
    wanted = leaves.select("site", "leaf", F.col("snapshot_no").alias("pair"), F.explode(F.array(F.struct(F.col("snapshot_no").alias("no"), F.lit(True).alias("later")), F.struct(F.col("prev_no").alias("no"), F.lit(False).alias("later")))).alias("w"))
    wanted = wanted.select("site", "leaf", "pair", F.col("w.no").alias("snapshot_no"), "w.later")
    rows = placed.join(wanted, ["site", "snapshot_no", "leaf"])
    md5 = F.struct("md5")
    both = rows.groupBy("site", F.col("pair").alias("snapshot_no"), "file_key").agg(F.max(F.when(F.col("later"), md5)).alias("now"), F.max(F.when(~F.col("later"), md5)).alias("then"))
    kind = (
        F.when(F.col("then").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("now.md5") != F.col("then.md5"), "changed")
    )
    return both.withColumn("change_kind", kind).where("change_kind is not null").select("site", "snapshot_no", "file_key", "change_kind")


def reported_against_derived(changes: DataFrame, reports: DataFrame) -> DataFrame:
    """Per site, snapshot and kind, how many derived changes the crawler's own lists state.

    ``reports`` has site, snapshot_no, updated_files and deleted_files; its names may still hold characters that the
    store replaces, and a run may be reported twice. Output: site, snapshot_no, change_kind, derived, reported, both.
    """
    safe = F.regexp_replace(F.regexp_replace("name", "^[^/]*/", ""), r'[<>:"/\\|?*]', "_")
    said = (
        reports.select("site", "snapshot_no", F.lit("changed").alias("change_kind"), F.explode("updated_files").alias("name"))
        .unionByName(reports.select("site", "snapshot_no", F.lit("removed").alias("change_kind"), F.explode("deleted_files").alias("name")))
        .select("site", "snapshot_no", "change_kind", F.concat("site", F.lit("/"), F.substring(safe, 1, 200)).alias("file_key"))
        .distinct()
        .withColumn("said", F.lit(1))
    )
    true = changes.where("change_kind <> 'added'").withColumn("is", F.lit(1))
    return (
        true.join(said, ["site", "snapshot_no", "change_kind", "file_key"], "full")
        .groupBy("site", "snapshot_no", "change_kind")
        .agg(F.count("is").alias("derived"), F.count("said").alias("reported"), F.sum(F.coalesce(F.col("is") * F.col("said"), F.lit(0))).alias("both"))
    )
