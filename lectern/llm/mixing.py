"""Mixing sources to target weights by pivotal dependent rounding, DataFrame operations only.

A source's target over its size is the copies its documents are to have on
average: a whole number for all, and a fraction that is rounded by the pivotal
method. Two fractional documents meet, mass in words is moved from one to the
other in the direction drawn at random so that each keeps its expected copies,
and one of them becomes whole; the other goes on. Thus every meeting keeps the
source's words, and what is left of a source in the end is one document, which is
rounded up with the probability of its fraction: the source's words miss its target by
less than one document.

The meetings are a reduction tree: documents are dealt to groups of about
``fan_in`` by the hash of their ids, each group leaves one residual document at
most, and the residuals are dealt again, until every source has one group. A hot
source has more groups, not larger ones. Rows that are equal in id, source and text
meet first, by counting: of ``n`` with the fraction p, the whole part of n p are rounded
up and one stands for what is left, so that many copies, or many null ids, are one
member of one group. Random numbers are hashes of ids and texts, so reruns agree.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of
its own, the last one; a source of no words has target 0; equal rows are each
dealt with; a null id is an id like any other; an empty table gives an empty table; other
columns, whatever their names, are ignored by ``mix`` and kept by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, columns_of, row_of, staged, uniform

WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, n_docs, source_size, target: one row per source.

    Resharing the excess until no source is above its limit ends where each
    source has the smaller of its limit and one rate times its weight. With
    sources in the order of limit / weight, the first ones are at their limits.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    left = (budget - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rates = per.withColumn("rate", left)
    # the rate of the first source that stays under its limit holds for all after it
    under = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rate"))).over(everything)["rate"]
    return rates.withColumn("common", under).select("source", "n_docs", "source_size", F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("common") * F.col("weight"))).alias("target"))


def _meet(members: Column) -> Column:
    """Fold an ordered array of struct(h, doc_id, size, text_hash, copies, p) into struct(rest, done): every
    member met in turn; ``rest`` is the fractional one that is left, or null."""
    member = "struct<h:bigint,doc_id:bigint,size:bigint,text_hash:bigint,copies:bigint,p:double>"
    start = F.struct(F.lit(None).cast(member).alias("rest"), F.array().cast(f"array<{member}>").alias("done"))

    def with_p(m: Column, p: Column) -> Column:
        return F.struct(m["h"].alias("h"), m["doc_id"].alias("doc_id"), m["size"].alias("size"), m["text_hash"].alias("text_hash"), m["copies"].alias("copies"), p.alias("p"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["rest"]
        ratio = new["size"].cast("double") / old["size"]
        # what `old` can gain from `new`, and what it can give
        gain, give = F.least(1 - old["p"], ratio * new["p"]), F.least(old["p"], ratio * (1 - new["p"]))
        up = uniform(old["h"], new["h"], old["doc_id"], new["doc_id"]) * (gain + give) < give
        p_old = F.when(up, F.when(1 - old["p"] <= ratio * new["p"], 1.0).otherwise(old["p"] + gain)).otherwise(F.when(old["p"] <= ratio * (1 - new["p"]), 0.0).otherwise(old["p"] - give))
        p_new = F.when(up, F.when(ratio * new["p"] <= 1 - old["p"], 0.0).otherwise(new["p"] - gain / ratio)).otherwise(F.when(ratio * (1 - new["p"]) <= old["p"], 1.0).otherwise(new["p"] + give / ratio))
        a, b = with_p(old, p_old), with_p(new, p_new)
        whole = lambda m: (m["p"] <= 1e-12) | (m["p"] >= 1 - 1e-12)
        both = F.when(whole(a) & whole(b), F.struct(F.lit(None).cast(member).alias("rest"), F.concat(acc["done"], F.array(a, b)).alias("done")))
        one = F.when(whole(a), F.struct(b.alias("rest"), F.concat(acc["done"], F.array(a)).alias("done"))).otherwise(F.struct(a.alias("rest"), F.concat(acc["done"], F.array(b)).alias("done")))
        return F.when(old.isNull(), F.struct(new.alias("rest"), acc["done"].alias("done"))).otherwise(F.coalesce(both, one))

    return F.aggregate(members, start, step)


def _mixed(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], fan_in: int, seed: int) -> DataFrame:
    """source, source_size, target, doc_id, size, text_hash, copies, rows: how many equal rows are taken so often."""
    sized = staged(sizes(docs))
    goal = staged(targets(sized, share, most, weights))
    rows = sized.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    about, own = ["source", "source_size", "target"], ["doc_id", "size", "text_hash", "copies"]
    equal = rows.withColumn("copies", F.floor(mean + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), mean - F.col("copies"))).groupBy(*about, "n_docs", *own, "p").agg(F.count("*").alias("rows"))
    # of equal rows the whole part of their fractions goes up, one row has the rest
    settled = (F.col("p") <= 1e-12) | (F.col("size") == 0)
    sum_p = F.col("rows") * F.col("p")
    up = F.when(settled, 0).otherwise(F.floor(sum_p + 1e-12)).cast("long")
    rest = F.when(settled, 0.0).otherwise(F.greatest(F.lit(0.0), sum_p - up))
    split = staged(equal.withColumns({"up": up, "rest": rest, "h": F.xxhash64("doc_id", "source", "text_hash", F.lit(seed))}))
    open_rows = (F.col("rest") > 1e-12).cast("long")
    done = [
        split.where("up > 0").select(*about, *own[:3], (F.col("copies") + 1).alias("copies"), F.col("up").alias("rows")),
        split.select(*about, *own, (F.col("rows") - F.col("up") - open_rows).alias("rows")).where("rows > 0"),
    ]
    open_ = split.where("rest > 1e-12").select(*about, "n_docs", "h", *own, F.col("rest").alias("p"))
    level, most_docs = 0, goal.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    groups = F.ceil(F.col("n_docs") / fan_in)
    one = F.lit(1).cast("long").alias("rows")
    while True:
        last = most_docs <= fan_in
        slot = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("h", F.lit(seed + level)), groups)
        folded = staged(open_.groupBy(*about, "n_docs", slot.alias("slot")).agg(_meet(F.array_sort(F.collect_list(F.struct("h", *own, "p")))).alias("r")))
        done.append(folded.select(*about, F.inline("r.done")).select(*about, *own[:3], (F.col("copies") + F.round("p").cast("long")).alias("copies"), one))
        rest = folded.where("r.rest is not null").select(*about, F.ceil(F.col("n_docs") / fan_in).alias("n_docs"), "r.rest.*")
        if last:
            drawn = F.col("copies") + (uniform("h", F.lit(seed)) < F.col("p")).cast("long")
            done.append(rest.select(*about, *own[:3], drawn.alias("copies"), one))
            break
        open_, most_docs, level = rest, -(-most_docs // fan_in), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, fan_in: int = 32, seed: int = 1) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row."""
    mixed = _mixed(docs, share, most, weights, fan_in, seed)
    again = F.when(F.col("rows") > 1, F.sequence(F.lit(1).cast("long"), F.col("rows"))).otherwise(F.array(F.lit(1).cast("long")))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.explode(again).alias("nth")).drop("nth")


def repeat_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, fan_in: int = 32, seed: int = 1) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay.

    Where rows of one id, source and text are taken unlike, rows that are equal in all
    columns are counted first, and then the counts are laid along the copies to give out.
    """
    key = ["doc_id", "source", "text_hash"]
    mixed = _mixed(docs, share, most, weights, fan_in, seed)
    # at most two numbers of copies for the rows of a key
    plan = staged(mixed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("copies", "rows")), asc=False).alias("plan")))
    alike = (F.array_max(F.transform("plan", lambda x: x["copies"])) == F.array_min(F.transform("plan", lambda x: x["copies"]))).alias("alike")
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_hash").alias("p_hash"), "plan", alike)
    given = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("from"), F.xxhash64("text").alias("hash"))
    match = F.col("id").eqNullSafe(F.col("p_id")) & F.col("from").eqNullSafe(F.col("p_source")) & (F.col("hash") == F.col("p_hash"))
    same = given.join(plan.where(F.col("alike") & (F.element_at("plan", 1)["copies"] > 0)), match).withColumn("times", F.element_at("plan", 1)["copies"])
    counted = given.join(plan.where("not alike"), match).groupBy("id", "from", "hash", "plan", "given").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("id", "from", "hash").orderBy(F.xxhash64("given")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    # the copies that fall to rows first .. first + rows of the key
    start = lambda k: F.aggregate(F.slice("plan", 1, k), F.lit(0).cast("long"), lambda n, x: n + x["rows"])
    shared = F.transform("plan", lambda x, k: x["copies"] * F.greatest(F.lit(0).cast("long"), F.least(F.col("first") + F.col("rows"), start(k) + x["rows"]) - F.greatest(F.col("first"), start(k))))
    unlike = placed.withColumn("times", F.aggregate(shared, F.lit(0).cast("long"), lambda n, x: n + x)).where("times > 0")
    taken = same.select("given", "times").unionByName(unlike.select("given", "times"))
    return taken.select("given", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")).select(*columns_of(docs))
