"""Similarity joins inside buckets: rounds of star-shaped candidate pairs, split by what sets members apart from a centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import forget, stored


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (bucket, key) of buckets with two keys or more, with ``members``: how many rows the bucket has. The rows are
    made and shuffled once; what is counted and what is joined read the same shuffle."""
    dealt = rows.repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("members"), F.min("key").alias("low"), F.max("key").alias("high"))
    return stored(dealt.join(shared.filter("low < high").drop("low", "high").hint("shuffle_hash"), "bucket"), "members")


def _first_pools(members: DataFrame) -> DataFrame:
    """(centre, key, company, alone): every member of a bucket with the bucket's centre, each such pair once. ``company`` is
    how many rows share the buckets of the key. Buckets of one centre are one pool; a pool of one pair is ``alone``."""
    company = members.groupBy("key").agg(F.sum("members").alias("company"))
    rows = members.select("bucket", "key").join(company, "key").repartition("bucket")
    tops = rows.groupBy("bucket").agg(F.max(F.struct("company", F.bitwise_not("key").alias("low"))).alias("top"))
    pairs = rows.join(tops.hint("shuffle_hash"), "bucket").select(F.bitwise_not("top.low").alias("centre"), "key", "company").filter("key != centre")
    pairs = stored(pairs.distinct(), "pairs")
    sizes = pairs.groupBy("centre").agg((F.count("*") == 1).alias("alone"))
    return pairs.join(sizes, "centre")


def _from_contents(pools: DataFrame, contents: DataFrame, shingles) -> DataFrame:
    """The pairs with what ``compared`` needs, from the contents of both. ``self`` and ``base`` are the key and the centre with
    their contents, as 64-bit hashes: a key may have two contents."""
    centres = contents.select(F.col("key").alias("centre"), "content").join(pools.select("centre").distinct(), "centre", "left_semi")
    # texts are shipped; a centre's set is made once, behind the shuffle
    centres = centres.repartition("centre").select("centre", F.xxhash64("centre", "content").alias("base"), shingles("content").alias("c"))
    both = pools.join(contents, "key").join(centres, "centre")
    both = both.select("base", "centre", F.xxhash64("key", "content").alias("self"), "key", "company", "alone", shingles("content").alias("x"), "c")
    return both.select("base", "centre", "self", "key", "company", "alone", F.size("x").alias("n"), F.size("c").alias("c_n"), F.array_except("x", "c").alias("more"), F.array_except("c", "x").alias("less"))


def _from_differences(pools: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (base, top, self, alone) with what ``compared`` needs. Both members of a pair have been compared with one
    centre, ``base``, and sets differ as their differences from a third one do, so no content is read again."""
    x = rows.select("base", "self", "key", "company", "n", "more", "less")
    t = rows.select("base", F.col("self").alias("top"), F.col("key").alias("centre"), F.col("n").alias("c_n"), F.col("more").alias("t_more"), F.col("less").alias("t_less"))
    both = pools.join(x, ["base", "self"]).join(t, ["base", "top"])
    more = F.concat(F.array_except("more", "t_more"), F.array_except("t_less", "less"))
    less = F.concat(F.array_except("t_more", "more"), F.array_except("less", "t_less"))
    return both.select(F.col("top").alias("base"), "centre", "self", "key", "company", "alone", "n", "c_n", more.alias("more"), less.alias("less"))


def compared(pools: DataFrame, known, threshold: int) -> DataFrame:
    """(base, centre, self, key, company, alone, n, more, less, apart, gap, linked) for the pairs of ``pools``, over whole
    shingle sets; ``known`` gives them the sizes n and c_n of the sets and their differences.

    Linked is 100 * intersection >= threshold * union. D(x) is ``more``, what x has and the centre lacks, and ``less``, what
    the centre has and x lacks (both null where the pair is alone); ``apart`` is |D(x)|, and ``gap`` is
    |D(x)| - n * (100 - threshold) / (100 + threshold).
    """
    both = known(pools)
    linked = 100 * (F.col("n") - F.size("more")) >= threshold * (F.col("c_n") + F.size("more"))
    both = both.withColumn("linked", linked).withColumn("apart", F.size("more") + F.size("less"))
    both = both.withColumn("gap", F.col("apart") - F.col("n") * ((100 - threshold) / (100 + threshold)))
    return both.drop("c_n").withColumns({d: F.when(~F.col("alone"), F.col(d)) for d in ("more", "less")})


def _with_parts(now: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs with ``part``, the component so far of the key, and ``linked`` where it is that of the centre."""
    for key, part in (("key", "part"), ("centre", "own")):
        now = now.join(parts.select(F.col("node").alias(key), F.col("component").alias(part)), key, "left").withColumn(part, F.coalesce(part, key))
    return now.withColumn("linked", F.col("part") == F.col("own")).drop("own")


#: A group ends where the pairs of its members that are of different components are at most half of this for each member.
#: It doubles from round to round, so that groups which stars do not split do not go on for long.
FEW = 8


#: So many shingles in which two differ from their centre are looked for in the first of either side, if they must share as many.
MANY = 128


def _groups(now: DataFrame, parts: DataFrame, threshold: int, few: int, spare: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(base, top, self, alone) and the members of ``now`` that it speaks of. These are the members of the groups that are to be compared on, with the best of the group (the most
    company); in groups of few pairs, with every better member of another component, which ends the group.

    Sets x and y are linked only if they share half of gap(x) + gap(y) members of D(x) and D(y), and at least one unless
    both are linked with the centre. So, with each D in one order (what the centre lacks first, since members lack the same of
    what it has more often than they have the same of what it lacks), the first |D| - that + MANY on either side share MANY,
    or that many if fewer. Of these, only shingles count that members of two components have. So, with them in one order,
    the pair shares one of the first k - MANY + 1 of the k that either side has left: the prefix. Members are dealt to
    classes by gap, those of the centre's component (``part``, as far as links are known) to a class of their own; the least
    gap and the largest D of a class bound what a member must share with any of it, and rule most classes out. A group is
    what two classes (or one) have with one shingle in such prefixes; one whose members are of one component already needs
    no pair. The order is by how many members have a shingle in D, rare ones first, so groups are small; any order gives the
    same components.
    """
    level = F.when(F.col("linked"), 0).otherwise(1 + F.floor(2 * F.log2(F.greatest(F.lit(1.0), F.col("gap"))))).cast("int")
    now = now.filter("not alone")
    sets, now = now.select("base", "self", "more", "less"), _with_parts(now.drop("more", "less"), parts).withColumn("class", level)
    classes = now.groupBy("base", "class").agg(F.min("gap").alias("least"), F.max("apart").alias("most"), F.count("*").alias("n"))
    classes = classes.groupBy("base").agg(F.collect_list(F.struct("class", "least", "most", "n")).alias("classes"), F.sum("n").alias("members"), F.max("class").alias("high"))
    rows = now.join(classes.filter("members > 1 and high > 0"), "base")
    need = lambda c: F.greatest(F.lit(1), F.ceil((F.col("gap") + c["least"]) / 2 - 1e-6)).cast("int")
    free = lambda c: (~F.col("linked") | (c["class"] > 0)) & ((c["class"] != F.col("class")) | (c["n"] > 1))
    some = F.filter("classes", lambda c: free(c) & (need(c) <= F.least(F.col("apart"), c["most"])))
    others = F.transform(some, lambda c: F.named_struct(F.lit("class"), c["class"], F.lit("need"), F.least(need(c), F.lit(MANY)), F.lit("long"), F.col("apart") - F.greatest(F.lit(0), need(c) - MANY)))
    rows = rows.withColumn("others", others).filter(F.size("others") > 0)
    ordered, longest = F.concat(F.sort_array("more"), F.sort_array("less")), F.array_max(F.transform("others", lambda c: c["long"]))
    # the differences are shipped once, those of members that have something to be compared with
    rows = stored(rows.select("base", "self", "key", "company", "n", "part", "class", "others").join(sets, ["base", "self"]), "open")
    # no column is left out below, so what is counted and what is joined read the same shuffle
    each = rows.select("base", "self", "part", F.explode(F.slice(ordered, 1, longest)).alias("e")).repartition("base", "e")
    common = each.groupBy("base", "e").agg(F.count("*").alias("often"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    each = each.join(common.hint("shuffle_hash"), ["base", "e"]).groupBy("base", "self").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("shared"))
    slim = ["self", "company", "n", "part", "class"]
    made = rows.select("base", *slim, "others").join(each, ["base", "self"]).withColumn("others", F.filter("others", lambda c: c["need"] <= F.size("shared")))
    least = F.array_min(F.transform("others", lambda c: c["need"]))
    made = made.filter(F.size("others") > 0).select("base", *slim, "others", F.size("shared").alias("k"), F.posexplode(F.slice("shared", 1, F.size("shared") - least + 1)).alias("place", "p"))
    made = made.select("base", F.col("p.e").alias("e"), *slim, F.explode(F.filter("others", lambda c: F.col("place") <= F.col("k") - c["need"])).alias("o"))
    made = made.select("base", "e", *slim, F.least("class", "o.class").alias("one"), F.greatest("class", "o.class").alias("two"))
    by = ["base", "e", "one", "two"]
    dealt = made.repartition(*by)
    parts = dealt.groupBy(*by, "part").agg(F.max(F.struct("company", "self")).alias("top"), F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    size = F.col("n").cast("double")
    groups = parts.groupBy(*by).agg(F.max("top").alias("top"), F.sum(size).alias("n"), F.sum(size * size).alias("within"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("part", "n").alias("main"))
    groups = groups.filter("within < n * n and low = one and high = two").select(*by, F.col("top.self").alias("top"), "main", (F.expr("n * n - within") <= few * F.col("n")).alias("ends"))
    made = stored(dealt.join(groups.hint("shuffle_hash"), by), "shared")
    spare.append(made)
    large = made.filter("not ends").select("base", "top", "self", F.lit(False).alias("alone"))
    # pairs of two components: one of the two is not of the group's main one
    small = made.filter("ends").select(*by, "main", *slim)
    other = small.select(*by, *[F.col(c).alias(f"o_{c}") for c in slim])
    apart = (F.col("one") == F.col("two")) | (F.col("class") != F.col("o_class"))
    better = F.struct("o_company", "o_self") > F.struct("company", "self")
    once = (F.col("o_part") == F.col("main")) | better
    alike = threshold * F.greatest("n", "o_n") <= 100 * F.least("n", "o_n")
    small = small.filter("part != main").join(other, by).filter((F.col("part") != F.col("o_part")) & once & apart & alike)
    small = small.select("base", F.when(better, F.col("o_self")).otherwise(F.col("self")).alias("top"), F.when(better, F.col("self")).otherwise(F.col("o_self")).alias("self"), F.lit(True).alias("alone"))
    return large.unionByName(small).filter("self != top"), rows


def star_links(members: DataFrame, contents: DataFrame, threshold: int, shingles=F.col) -> DataFrame:
    """Edges (a < b) with the components that comparing all pairs of each bucket would give, without making them: each node
    with the smallest key of its component.

    The centre of a bucket is the member of the most company (the least edited text of a family), then of the smallest
    key. All others are compared with it. Two members that are not linked with the centre, or one of which is
    not, can be linked with each other only if they share enough of the shingles that set them apart from it
    (``_groups``). Such a shared shingle makes a group, groups are buckets of the next round, and so on until the members
    of each group are of one component; groups with few pairs of two components end at once (FEW). Components are united
    after each round. Every pair of a bucket is thus compared, or in one component already, or shown to be unlike. Centres
    descend in rank from round to round, so the rounds end. A version of a family, whose members share
    what sets them apart, is one star of the next round, so pairs grow with the members of a family, not with their square.

    Contents are read in the first round only: what sets two members apart is what only one of them has in its difference
    from their centre, so later rounds work on these differences, which are short.

    ``shingles`` makes the set (distinct) of a content. A key that has two contents is linked if either is.
    """
    pools, known = _first_pools(members), lambda p: _from_contents(p, contents, shingles)
    links, few, spare = None, FEW, []
    while True:
        now = stored(compared(pools, known, threshold), "compared")
        forget(spare)
        found = now.filter("linked").select(F.least("centre", "key").alias("a"), F.greatest("centre", "key").alias("b"))
        parts = components(found if links is None else found.unionByName(links))
        links = parts.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        spare.append(now)
        pools, rows = _groups(now, parts, threshold, few, spare)
        # a pair that two pools know is compared once, in either; it is alone if it is so in all groups
        pools = stored(pools.groupBy("top", "self").agg(F.min("base").alias("base"), F.bool_and("alone").alias("alone")), "pools")
        forget(spare)
        spare += [rows, pools]
        if pools.isEmpty():
            forget(spare)
            return links
        sizes = pools.filter("not alone").groupBy("top").agg((F.count("*") == 1).alias("one"))
        pools, known = pools.join(sizes, "top", "left").select("base", "top", "self", (F.col("alone") | F.col("one")).alias("alone")), lambda p, rows=rows: _from_differences(p, rows)
        few *= 2
