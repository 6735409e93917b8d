"""Rule comparison of two listings: all stated facts must agree, prices must fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemesh.config import RuleConfig
from pricemesh.operators.scoring import DIFFERENT, EXACT

# field, label, label at the start of a sentence
_FACTS = [
    ("brand", "brand", "Brand"), ("storage", "storage", "Storage"), ("ram", "RAM", "Ram"),
    ("colour", "colour", "Colour"), ("quantity", "size/quantity", "Size/quantity"),
]


def set_dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def _reason(label, status: str) -> Column:
    text = label if isinstance(label, Column) else F.lit(label)
    return F.struct(text.alias("label"), F.lit(status).alias("status"))


def compare(pairs: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Add class, scores and reasons to pairs carrying identity_*, accessory_* and price_*."""
    c = F.col
    a, b = (lambda k: c(f"identity_a.{k}")), (lambda k: c(f"identity_b.{k}"))
    staged = (
        pairs.withColumn("_family", set_dice(a("family"), b("family")))
        .withColumn(
            "_ratio",
            F.greatest("price_a", "price_b") / F.greatest(F.lit(1.0), F.least("price_a", "price_b")),
        )
        .withColumn("_same_model", a("model") == b("model"))
        .withColumn("_no_model", (F.size(a("model")) == 0) & (F.size(b("model")) == 0))
        .withColumn(
            "_split",
            ~c("_no_model") & (F.size(a("family")) > 0) & (F.size(b("family")) > 0)
            & ~F.arrays_overlap(a("family"), b("family")),
        )
        .withColumn(
            "_vague", F.coalesce(*[x(k) for k in ("storage", "colour", "quantity") for x in (a, b)]).isNull()
        )
        .withColumn("_dear", c("_ratio") > F.when(c("_vague"), cfg.vague_price_ratio).otherwise(cfg.price_ratio))
    )
    clash = F.lit(False)
    for field, _, _ in _FACTS:
        clash = clash | F.coalesce(a(field) != b(field), F.lit(False))
    ok = (
        ~clash & c("_same_model") & (a("condition") == b("condition")) & (c("accessory_a") == c("accessory_b"))
        & ~c("_split") & ~c("_dear") & (~c("_no_model") | (c("_family") >= cfg.family_dice))
    )

    def fact(field: str, label: str, name: str) -> Column:
        x, y = a(field), b(field)
        differs = F.concat(F.lit(f"{name} differs ("), x, F.lit(" vs "), y, F.lit(")"))
        return (
            F.when(x == y, _reason(f"Same {label}", "ok"))
            .when(x.isNotNull() & y.isNotNull(), _reason(differs, "warn"))
            .when(x.isNotNull() | y.isNotNull(), _reason(f"{name} not stated on one listing", "info"))
        )

    shown = lambda m: F.when(F.size(m) > 0, F.array_join(m, " ")).otherwise("—")
    model = F.when(
        ~c("_same_model"),
        _reason(F.concat(F.lit("Model differs ("), shown(a("model")), F.lit(" vs "), shown(b("model")), F.lit(")")), "warn"),
    ).when(~c("_no_model"), _reason(F.concat(F.lit("Same model ("), shown(a("model")), F.lit(")")), "ok"))
    condition = F.when(
        a("condition") == b("condition"), _reason(F.concat(F.lit("Both "), a("condition")), "ok")
    ).otherwise(
        _reason(F.concat(F.lit("Condition differs ("), a("condition"), F.lit(" vs "), b("condition"), F.lit(")")), "warn")
    )
    far = F.concat(
        F.lit("Prices too far apart for the same item ("), F.format_number("_ratio", 1), F.lit("×)")
    )
    price = F.when(c("_dear"), _reason(far, "warn")).otherwise(_reason("Prices consistent", "ok"))
    line = F.when(c("_split"), _reason("Different product line", "warn"))
    facts = [fact(*f) for f in _FACTS]
    ordered = F.array(facts[0], model, *facts[1:], condition, line, price)

    closeness = 0.2 * (1 - (c("_ratio") - 1) / (cfg.price_ratio - 1 + 1e-9))
    exact = F.least(F.lit(0.99), F.round(0.55 + 0.25 * F.least(F.lit(1.0), c("_family") + 0.3) + closeness, 4))
    return (
        staged.withColumn("_ok", ok)
        .withColumn("text_score", F.round("_family", 4))
        .withColumn("attribute_score", F.when(c("_ok"), 1.0).otherwise(0.0))
        .withColumn("image_score", F.lit(0.0))
        .withColumn("combined_score", F.when(c("_ok"), exact).otherwise(0.4))
        .withColumn("match_type", F.when(c("_ok"), EXACT).otherwise(DIFFERENT))
        .withColumn("reasons", F.filter(ordered, lambda r: r.isNotNull()))
        .drop("_family", "_ratio", "_same_model", "_no_model", "_split", "_vague", "_dear", "_ok")
    )
