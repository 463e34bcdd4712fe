"""Algebra of spans (doc, start, end, label, priority): merge, difference, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, over, running_max


def merge(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Overlapping spans become one; touching ones stay apart. The first span's label holds if it alone spans the union, else SECRET."""
    order = Window.partitionBy(id_col).orderBy("start", F.desc("end"), F.desc("priority"), "label")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    marked = df.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct("start", (-F.col("end")).alias("negative_end"), (-F.col("priority")).alias("negative_priority"), "label"))
    out = marked.groupBy(id_col, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("f"))
    label = F.when(F.col("end") == -F.col("f.negative_end"), F.col("f.label")).otherwise(F.lit("SECRET"))
    return out.select(id_col, "start", "end", label.alias("label"))


MERGED = "array<struct<start:int,end:int,label:string>>"


def merged_sql(found: str) -> str:
    """merge() of one row's spans, an array of structs with start, end, label, priority: [(start, end, label)], in order."""
    keyed = f"array_sort(transform({found}, x_ -> named_struct('start', x_.start, 'e', -x_.end, 'p', -x_.priority, 'label', x_.label)))"
    firsts = "filter(sequence(0, size(o_) - 1), i_ -> CASE WHEN i_ = 0 THEN true ELSE o_[i_].start >= r_[i_ - 1] END)"
    reach = "r_[CASE WHEN j_ + 1 < size(f_) THEN f_[j_ + 1] ELSE size(o_) END - 1]"
    island = f"named_struct('start', o_[i_].start, 'end', {reach}, 'label', CASE WHEN {reach} = -o_[i_].e THEN o_[i_].label ELSE 'SECRET' END)"
    islands = let("transform(o_, x_ -> -x_.e)", "n_", let(running_max("n_"), "r_", let(firsts, "f_", f"transform(f_, (i_, j_) -> {island})")))
    # Most texts have one span or two, which need no running values.
    apart = "transform(o_, x_ -> named_struct('start', x_.start, 'end', -x_.e, 'label', x_.label))"
    both = "array(named_struct('start', o_[0].start, 'end', -least(o_[0].e, o_[1].e), 'label', CASE WHEN o_[0].e <= o_[1].e THEN o_[0].label ELSE 'SECRET' END))"
    few = f"WHEN size(o_) = 1 THEN {apart} WHEN size(o_) = 2 THEN CASE WHEN o_[1].start >= -o_[0].e THEN {apart} ELSE {both} END"
    return let(keyed, "o_", f"CASE WHEN coalesce(size(o_), 0) <= 0 THEN cast(array() AS {MERGED}) {few} ELSE {islands} END")


def merged(found: Column) -> Column:
    return over(found, "a_", merged_sql("a_"))


def without_sql(spans: str, protected: str) -> str:
    """difference() of one row: spans, merged, without what the disjoint protected ones cover, both in order."""
    a = "CASE WHEN j_ = 0 THEN x_.start ELSE greatest(x_.start, u_[j_ - 1].end) END"
    b = "CASE WHEN j_ = size(u_) THEN x_.end ELSE least(x_.end, u_[j_].start) END"
    rest = f"filter(transform(sequence(0, size(u_)), j_ -> named_struct('start', {a}, 'end', {b}, 'label', x_.label)), y_ -> y_.start < y_.end)"
    left = let(f"filter({protected}, p_ -> p_.start < x_.end AND p_.end > x_.start)", "u_", rest)
    return f"CASE WHEN size({protected}) = 0 THEN {spans} ELSE flatten(transform({spans}, x_ -> {left})) END"


def without(spans: Column, protected: Column) -> Column:
    return over(F.struct(spans.alias("s"), protected.alias("p")), "b_", without_sql("b_.s", "b_.p"))


def difference(df: DataFrame, protected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Merged spans without what the disjoint protected spans (id, start, end) cover; remainders keep the label.

    The join has the document as equi key, so it is never a nested loop over all spans.
    """
    p = protected.select(F.col(id_col).alias("pid"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    m = df.select(id_col, "start", "end", "label")
    cuts = m.join(p, (F.col(id_col) == F.col("pid")) & (F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start"))).select(id_col, "start", "end", "label", F.col("ps").alias("s"), F.col("pe").alias("e"))
    marks = cuts.unionByName(m.select(id_col, "start", "end", "label", F.col("end").alias("s"), F.col("end").alias("e")))
    before = F.lag("e").over(Window.partitionBy(id_col, "start").orderBy("s", "e"))
    gaps = marks.select(id_col, "label", F.greatest("start", F.coalesce(before, "start")).alias("a"), F.col("s").alias("b"))
    return gaps.where("a < b").select(id_col, F.col("a").alias("start"), F.col("b").alias("end"), "label")


def covered(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of code points covered, for each document, of merged spans."""
    return df.groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def uncovered_by(small: DataFrame, large: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans of small, a merge of fewer rules, that no span of large contains. Empty if coverage is monotone."""
    a, b = small.alias("a"), large.alias("b")
    inside = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.end") >= F.col("a.end"))
    return a.join(b, inside, "left_anti")


#: Kinds of spans that one sweep tells apart; a running count each.
KINDS = 64


def segments(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """kinds, chars: how many code points are covered by spans of exactly these kinds, of rows (id, start, end, kind int).

    The ends of a document's spans cut it into elementary intervals. One sweep in order carries a count for each kind, so that a set of kinds is known for
    every interval: whatever is asked of any choice of kinds can be answered from the sums.
    """
    kinds = sorted(r.kind for r in spans.select("kind").distinct().limit(KINDS + 1).collect())
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds")
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    marks = spans.select(id_col, "kind", F.explode(ends).alias("m")).select(id_col, "kind", "m.*")
    steps = marks.groupBy(id_col, "at").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"k{k}") for k in kinds])
    order = Window.partitionBy(id_col).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = steps.select((F.lead("at").over(order) - F.col("at")).alias("chars"), F.array_compact(F.array(*[F.when(F.sum(f"k{k}").over(so_far) > 0, F.lit(k)) for k in kinds]) if kinds else F.expr("cast(array() as array<int>)")).alias("kinds"))
    return swept.where(F.col("chars").isNotNull() & (F.size("kinds") > 0)).groupBy("kinds").agg(F.sum("chars").cast("long").alias("chars"))


def coverage_steps(spans: DataFrame, bits: int, id_col: str = "doc_id") -> DataFrame:
    """choice, added, before, after, lost for each choice of flags and each flag: code points covered without and with it, and covered without it alone.

    spans: id, start, end, bit, hidden_by. A span stands in a choice that has its bit and none of hidden_by, 0 for rules that don't look at others. lost is 0
    throughout if coverage is monotone. All 2^bits choices are answered from one sweep.
    """
    of = segments(spans.withColumn("kind", (F.col("hidden_by") * 32 + F.col("bit")).cast("int")), id_col)
    steps = of.select("chars", "kinds", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))).alias("choice")).select("chars", "kinds", "choice", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("added"))
    both = steps.withColumn("more", F.expr("choice | shiftleft(1, added)")).select("choice", "added", "chars", _stands("choice").alias("b"), _stands("more").alias("a"))
    total = lambda test: F.sum(F.when(test, F.col("chars")).otherwise(0)).cast("long")
    return both.groupBy("choice", "added").agg(total(F.col("b")).alias("before"), total(F.col("a")).alias("after"), total(F.col("b") & ~F.col("a")).alias("lost"))


def _stands(choice: str) -> Column:
    return F.expr(f"exists(kinds, k -> ({choice} & shiftleft(1, k % 32)) <> 0 AND ({choice} & (k div 32)) = 0)")


def outside_sql(small: str, large: str) -> str:
    """uncovered_by() of one row: those of the merged spans small that none of the merged spans large contains.

    Both are disjoint and in order, so the span of large that can contain one is the last that begins no later: what the ends of large reach so far decides.
    """
    mark = lambda some, kind, far: f"transform({some}, x_ -> named_struct('start', x_.start, 'kind', {kind}, 'end', x_.end, 'far', {far}))"
    marks = f"array_sort(concat({mark(large, 0, 'x_.end')}, {mark(small, 1, '-1')}))"
    left = let("transform(w_, x_ -> x_.far)", "n_", let(running_max("n_"), "r_", "filter(w_, (x_, i_) -> x_.kind = 1 AND r_[i_] < x_.end)"))
    return let(marks, "w_", left)


def splice(text: Column, parts: Column) -> Column:
    """text with each of parts [(start, end, token)], sorted and disjoint, replaced by its token."""
    n = F.size(parts)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(parts, i - 1).end)
    piece = lambda p, i: F.concat(F.substring(text, before(i) + 1, p.start - before(i)), p.token)
    tail = F.substring(text, F.get(parts, n - 1).end + 1, F.length(text))
    return F.when(n > 0, F.concat(F.array_join(F.transform(parts, piece), ""), tail)).otherwise(text)
