"""Scenes made by arithmetic: change that is known, formats, optical-SAR pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as BE
from ..operators import change as CH
from ..operators import fusion as U
from ..operators import scoring as S
from ..sources import fixtures as X
from ..store import written
from . import query
from .imagery import difference_sql

_AT = f"with gr as (select (i // {X.SIDE})::int as y, (i % {X.SIDE})::int as x from range({X.SIDE * X.SIDE}) r(i)), "
_FX = _AT + "fx as (" + X.sql("pairs") + ")"
_FOUND = _FX + difference_sql("fx", X.SIDE, X.SIDE, 3)
_VALUES = "ex as (select * from (values " + ", ".join(
    f"('{n}', '{p.formats}', {str(p.change).lower().replace('none', 'null')})"
    for n, p in X.PAIRS.items()
) + ") v(scene, formats, change))"
_ZONAL = ", tt as (select scene, count(*) as total from df group by scene), cc as (select scene, count(*) as n from cl group by scene), zo as (select scene, coalesce(n, 0)::bigint as changed, round(coalesce(n, 0)::double / total * 100.0::double, 4) as ratio_pct from tt left join cc using (scene))"


def _pairs(spark):
    """Made once, then read by whoever needs them."""
    return written(X.pairs(spark), "pairs")


def _optical_sar(spark):
    return written(X.optical_sar(spark), "optical_sar")


@query(
    "src14_fixture_pairs",
    _FX + " select scene, count(*) as n, " + ", ".join(
        f"sum({t}[{k}]) as {t}{k}, sum({t}[{k}] * ((y * 31 + x * 17) % 101)) as {t}{k}_placed"
        for t in "ab"
        for k in (1, 2, 3)
    ) + " from fx group by scene",
)
def src14(spark, d):
    """Every scene's sums, plain and weighted by place."""
    at = (F.col("y") * 31 + F.col("x") * 17) % 101
    sums = [
        f(F.sum(F.get(t, F.lit(k - 1)) * w)).alias(f"{t}{k}{name}")
        for t in "ab"
        for k in (1, 2, 3)
        for f, w, name in ((lambda c: c, F.lit(1), ""), (lambda c: c, at, "_placed"))
    ]
    return _pairs(spark).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    "src14_fixture_optical_sar",
    _AT + "os as (" + X.sql("optical_sar") + ") select scene, count(*) as n, " + ", ".join(
        f"round(sum({c}), 4) as {c}, round(sum({c} * ((y * 31 + x * 17) % 101)), 4) as {c}_placed"
        for c in ("r", "g", "b", "sar")
    ) + " from os group by scene",
)
def src14_os(spark, d):
    at = (F.col("y") * 31 + F.col("x") * 17) % 101
    return _optical_sar(spark).groupBy("scene").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(F.col(c) * w), 4).alias(c + name) for c in ("r", "g", "b", "sar") for w, name in ((F.lit(1), ""), (at, "_placed"))],
    )


@query("cmp1_win2_fixture_mask", _FOUND + " select scene, y, x from cl")
def cmp1(spark, d):
    return CH.detect(_pairs(spark), X.SIDE, X.SIDE)["mask"]


@query("ben2_agg17_flt17_format_matrix", _FOUND + _ZONAL + ", " + _VALUES + """, ve as (select ex.*, ratio_pct >= 1.0 and changed > 100 as found from ex join zo using (scene) where change is not null)
select formats, count(*) as n, count_if(found = change) as correct, count_if(found and not change) as false_positives, round(count_if(found = change)::double / count(*) * 100.0::double, 2) as accuracy_pct from ve group by formats""")
def ben2(spark, d):
    """The scenes with an expectation of change; how well the pairs align has no SQL (see ben2_format_audit)."""
    a = BE.format_audit(_pairs(spark), X.expected(spark), X.SIDE, X.SIDE).where("change is not null")
    return S.format_matrix(a).drop("misaligned")


@query("ben2_format_audit")
def ben2_audit(spark, d):
    """Each scene's verdict, the shifted one's too: phase correlation isn't for SQL."""
    return BE.format_audit(_pairs(spark), X.expected(spark), X.SIDE, X.SIDE)


_NUIS = ["none", "illumination", "shadow", "seasonal_color", "registration"]
_CATS = ["urban", "forest", "water", "agriculture"]


@query("ben1_change_benchmark", _FOUND + f""", tr as (select scene, y, x from fx where abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) > 60), bo as (select scene, y, x, max(p) as p, max(t) as t from (select scene, y, x, 1 as p, 0 as t from cl union all select scene, y, x, 0, 1 from tr) group by all),
co as (select scene, sum(p * t)::bigint as tp, sum(p * (1 - t))::bigint as fp, sum(t * (1 - p))::bigint as fn from bo group by scene), sa as (select distinct scene from fx), c as (select sa.scene, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, {X.SIDE * X.SIDE} - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) as tn from sa left join co using (scene)),
pr as (select *, case when tp + fp + fn = 0 then 1 when tp + fp > 0 then tp::double / (tp + fp) else 0 end as p, case when tp + fp + fn = 0 then 1 when tp + fn > 0 then tp::double / (tp + fn) else 0 end as r from c)
select scene, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2.0::double * p * r / (p + r) else 0 end, 4) as f1 from pr""")
def ben1(spark, d):
    """CVA on every scene, against the pixels whose colours differ by 60 in all."""
    p = _pairs(spark)
    gap = F.aggregate(F.zip_with("a", "b", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
    i = F.substring("scene", 1, 2).cast("int")
    at = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), i % len(vs) + 1)
    samples = X.expected(spark).select(
        "scene",
        F.lit(X.SIDE * X.SIDE).cast("long").alias("pixels"),
        at(_CATS).alias("category"),
        at(_NUIS).alias("nuisance"),
        (i % 3 != 0).alias("quantitative"),
        i.alias("ord"),
    )
    out = BE.change_benchmark(CH.detect(p, X.SIDE, X.SIDE)["mask"], p.where(gap > 60), samples)["samples"]
    return out.select("scene", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


@query("agg4_fixture_regions")
def agg4(spark, d):
    """Regions of the optical-SAR scenes, held against their shapes by a test; labelling 65,536 pixels by recursion is too slow in SQL."""
    k = U.classes(_optical_sar(spark), X.SIDE, X.SIDE)
    return U.class_regions(k, X.SIDE, X.SIDE).drop("r", "g", "b")
