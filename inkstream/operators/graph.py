"""Triples (s, p, o): profiles, contacts, and closures over links."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstream.shared import settled


def _settled(df: DataFrame) -> DataFrame:
    """The rows of a step as a table, in no more files than a shuffle has partitions."""
    return settled(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "closure")


def _sorted(df: DataFrame) -> DataFrame:
    """For joins with tables that grow with the nodes: by sorting. A file of numbers is some tenth of what they take as
    rows, so by its size Spark would broadcast tables of millions of rows, in each round, through the driver."""
    return df.hint("merge")


def profile(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """A row for each subject with the (least) object of every named predicate, null where there is none.

    One aggregate instead of a chain of left joins.
    """
    return triples.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in predicates.items()])


def contacts(triples: DataFrame, knows: str, see_also: str, name: str) -> DataFrame:
    """(s, contact, see_also, name): whom a subject knows and where more is said of them; the name may be missing."""
    known = triples.filter(F.col("p") == knows).select("s", F.col("o").alias("contact"))
    more = triples.filter(F.col("p") == see_also).select(F.col("s").alias("contact"), F.col("o").alias("see_also"))
    names = triples.filter(F.col("p") == name).select(F.col("s").alias("contact"), F.col("o").alias("name"))
    return known.join(more, "contact").join(names, "contact", "left").select("s", "contact", "see_also", "name")


def _doubled(active: DataFrame, combine: dict[str, Column], state: DataFrame) -> DataFrame:
    """One round of pointer doubling: active rows (id, jump, ...) take what their jump holds in the state (columns with a
    leading _).

    A node that many jump to is one row of the side that is looked up; AQE splits the rows that look it up.
    """
    held = state.select(F.col("id").alias("jump"), *[F.col(c).alias(f"_{c}") for c in state.columns if c != "id"])
    return active.join(_sorted(held), "jump", "left").select("id", *[c.alias(name) for name, c in combine.items()])


def tree_ends(nodes: DataFrame) -> DataFrame:
    """For every id of nodes (id, parent): kind, depth and top. Kind is `root` if its parents lead to a node without a
    parent (top: that node, depth: steps to it), `orphan` if they lead to a parent that is not there (top: that parent,
    depth: steps to the last node that is), `cycle` if they never end (top: the least id of the cycle, depth: null).

    Pointers are doubled: each round every node learns what lies twice as far above it, so a chain of n nodes takes about
    log2(n) rounds. Rounds end when all nodes have an end, or when a round gave none an end: what is left leads to cycles. Null ids are left out; of a repeated id the row with the least parent counts, one without first.
    """
    once = nodes.filter("id is not null").groupBy("id").agg(F.min_by("parent", F.struct(F.col("parent").isNotNull(), "parent")).alias("parent"))
    # The top so far, how many steps it is away, the least id on the way, and where to look next (null: nowhere).
    known = _settled(once)
    there = known.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    step = F.when(F.col("_there"), F.col("parent"))
    state = _settled(
        known.join(_sorted(there), "parent", "left").select(
            "id", step.alias("jump"), F.when(step.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("id").alias("low"),
            F.when(F.col("parent").isNull(), F.struct(F.lit("root").alias("kind"), F.col("id").alias("top")))
            .when(F.col("_there").isNull(), F.struct(F.lit("orphan").alias("kind"), F.col("parent").alias("top"))).alias("end"),
        )
    )
    combine = {
        "jump": F.col("_jump"),
        "depth": F.col("depth") + F.coalesce("_depth", F.lit(0)),
        "low": F.least("low", "_low"),
        "end": F.coalesce("end", "_end"),
    }
    before = -1
    for k in itertools.count(1):
        open_ = state.filter("end is null").count()
        if not open_:
            return state.select("id", "end.kind", "depth", "end.top")
        # A way that ends would have seen a node end among twice the steps; and no cycle is longer than the steps taken.
        if open_ == before and open_ <= 1 << (k - 1):
            break
        before = open_
        # Ended nodes keep what they have; they are looked up, but do not look.
        state = _settled(_doubled(state.filter("end is null"), combine, state).unionByName(state.filter("end is not null")))
    # Every open node now points into its cycle, and the least id on a way that starts within a cycle is the cycle's.
    lost = state.filter("end is null")
    names = lost.select(F.col("id").alias("jump"), F.col("low").alias("top"))
    ended = state.filter("end is not null").select("id", "end.kind", "depth", "end.top")
    return ended.unionByName(lost.join(_sorted(names), "jump").select("id", F.lit("cycle").alias("kind"), F.lit(None).cast("long").alias("depth"), "top"))


def flatten_tree(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """A row for every id of nodes (id, parent, title): kind, depth and top as `tree_ends` gives them, and the path of
    titles from the top node down; null for members of a cycle and what hangs on one.

    Paths are put together by doubling too, so their rounds are few; null titles are left out.
    """
    once = nodes.filter("id is not null").groupBy("id").agg(F.min_by(F.struct("parent", "title"), F.struct(F.col("parent").isNotNull(), "parent", "title")).alias("n"))
    rows = _settled(once.select("id", "n.parent", "n.title"))
    ends = _settled(tree_ends(rows))
    jump = F.when((F.col("depth") > 0) & (F.col("kind") != "cycle"), F.col("parent"))
    state = _settled(rows.join(_sorted(ends.filter("kind <> 'cycle'")), "id").select("id", jump.alias("jump"), F.array_compact(F.array("title")).alias("titles")))
    combine = {"jump": F.col("_jump"), "titles": F.concat("_titles", "titles")}
    while not state.filter("jump is not null").isEmpty():
        state = _settled(_doubled(state.filter("jump is not null"), combine, state).unionByName(state.filter("jump is null")))
    return ends.join(_sorted(state.select("id", F.array_join("titles", separator).alias("path"))), "id", "left").select("id", "kind", "depth", "top", "path")


def follow_next(start: DataFrame, links: DataFrame) -> DataFrame:
    """(page, hops): pages reached from the start over (src, dst) links, each once, at the fewest hops; to the last page.

    Runs of pages that lead to one page each, as `next` links do, are followed by pointer doubling: in about log2(n) joins
    for n pages, also around cycles. Pages that lead to several start a further step.
    """
    known = _settled(links.filter("src is not null and dst is not null").distinct())
    by_page = known.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    single = _settled(by_page.filter("n = 1").select("src", "dst"))
    many = known.join(by_page.filter("n > 1").select("src"), "src", "left_semi")
    jumps, size = [single], single.count()
    while (1 << len(jumps)) <= size:
        far = jumps[-1].select(F.col("src").alias("dst"), F.col("dst").alias("_dst"))
        jump = _settled(jumps[-1].join(_sorted(far), "dst").select("src", F.col("_dst").alias("dst")))
        if jump.isEmpty():
            break
        jumps.append(jump)
    least = lambda df: df.groupBy("page").agg(F.min("hops").alias("hops"))
    seen, front = None, _settled(start.select("page").distinct().filter("page is not null").withColumn("hops", F.lit(0)))
    while True:
        for k, jump in enumerate(jumps):
            there = front.join(_sorted(jump), F.col("page") == F.col("src")).select(F.col("dst").alias("page"), (F.col("hops") + (1 << k)).alias("hops"))
            front = _settled(least(front.unionByName(there)))
        if seen is not None:
            front = front.join(seen.withColumnRenamed("hops", "_hops"), "page", "left").filter("_hops is null or hops < _hops").drop("_hops")
        front = _settled(front)
        if front.isEmpty():
            return seen
        seen = front if seen is None else _settled(least(seen.unionByName(front)))
        front = _settled(least(front.join(many, F.col("page") == F.col("src")).select(F.col("dst").alias("page"), (F.col("hops") + 1).alias("hops"))))
        if front.isEmpty():
            return seen


def discovery_ladder(candidates: DataFrame, key: str, stage: str = "stage") -> DataFrame:
    """Of each key's candidates those of its first stage that has any, each once. The candidates are made and shuffled once;
    a key's candidates, such as a page's links, meet in one task."""
    first = F.min(stage).over(Window.partitionBy(key))
    return candidates.withColumn("_first", first).filter(F.col(stage) == F.col("_first")).drop("_first").distinct()
