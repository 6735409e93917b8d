"""Profile pairs that can reach the similar threshold, without losing any.

Pairs of different brand or of unrelated category always end as different, so
profiles are compared only inside (category, brand) blocks, plus the blocks
where one side does not state the brand or the category.  A block is cut into
cells of bounded size and every two cells form one tile; a tile is one small
numpy comparison and returns only the pairs whose score can still reach the
threshold.  A block holding a third of all profiles becomes many tiles on many
executors instead of one large task, and no pair list of a block is ever built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemesh.config import MatchConfig

PAIR = "profile_a bigint, profile_b bigint, dice double, cosine double"
_SLACK = 0.002   # more than the rounding of the scores can move


def _blocks(profiles: DataFrame, cell_rows: int) -> DataFrame:
    sizes = profiles.groupBy("category_block", "brand_block").agg(F.count("*").alias("n"))
    return sizes.withColumn("cells", F.ceil(F.col("n") / cell_rows).cast("int"))


def _block_pairs(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Compatible pairs of blocks as (cat_x, brand_x, cells_x, cat_y, brand_y, cells_y)."""
    x = blocks.select(*[F.col(c).alias(c + "_x") for c in ("category_block", "brand_block", "cells")])
    y = blocks.select(*[F.col(c).alias(c + "_y") for c in ("category_block", "brand_block", "cells")])
    cx, cy, bx, by = (F.col(c) for c in ("category_block_x", "category_block_y", "brand_block_x", "brand_block_y"))

    same = blocks.select(
        *[F.col(c).alias(c + s) for s in ("_x", "_y") for c in ("category_block", "brand_block", "cells")]
    )
    no_brand = x.filter(bx.isNull()).join(y.filter(by.isNotNull()), cx.eqNullSafe(cy))
    # One side has no category: such pairs must share a title token as well,
    # so blocks meet only over a common token.
    token_blocks = profiles.select(
        "category_block", "brand_block", F.explode("title_tokens").alias("token")
    ).distinct()
    left = token_blocks.filter("category_block is null").select(
        "token", *[F.col(c).alias(c + "_x") for c in ("category_block", "brand_block")]
    )
    right = token_blocks.filter("category_block is not null").select(
        "token", *[F.col(c).alias(c + "_y") for c in ("category_block", "brand_block")]
    )
    met = (
        left.join(right, "token")
        .filter(bx.isNull() | by.isNull() | (bx == by))
        .drop("token")
        .distinct()
    )
    null_safe = lambda s: blocks.select(*[F.col(c).alias(c + s) for c in ("category_block", "brand_block", "cells")])
    no_category = (
        met.withColumnsRenamed({"category_block_x": "_cx", "brand_block_x": "_bx"})
        .join(
            null_safe("_x"),
            F.col("_cx").eqNullSafe(F.col("category_block_x")) & F.col("_bx").eqNullSafe(F.col("brand_block_x")),
        )
        .withColumnsRenamed({"category_block_y": "_cy", "brand_block_y": "_by"})
        .join(
            null_safe("_y"),
            F.col("_cy").eqNullSafe(F.col("category_block_y")) & F.col("_by").eqNullSafe(F.col("brand_block_y")),
        )
    )
    columns = [c + s for s in ("_x", "_y") for c in ("category_block", "brand_block", "cells")]
    return same.select(columns).unionByName(no_brand.select(columns)).unionByName(no_category.select(columns))


def _cell(category: str, brand: str, cell: str):
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat_ws("\u0001", part(category), part(brand), F.col(cell).cast("string"))


def tiles(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tile, cell, side) rows: which cells meet in which tile."""
    pairs = _block_pairs(profiles, blocks)
    same = F.col("category_block_x").eqNullSafe(F.col("category_block_y")) & F.col("brand_block_x").eqNullSafe(
        F.col("brand_block_y")
    )
    cells = (
        pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cells_x") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cells_y") - 1)))
        .filter(~same | (F.col("i") <= F.col("j")))
        .select(
            _cell("category_block_x", "brand_block_x", "i").alias("left"),
            _cell("category_block_y", "brand_block_y", "j").alias("right"),
        )
        .withColumn("tile", F.concat_ws("\u0004", "left", "right"))
    )
    sides = F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return cells.withColumn("side", F.explode(sides)).select(
        "tile", "side", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")).alias("cell")
    )


def _token_matrix(rows: pd.Series, codes: dict) -> np.ndarray:
    out = np.zeros((len(rows), len(codes)))
    for i, words in enumerate(rows):
        known = [codes[w] for w in words if w in codes]
        out[i, known] = 1.0
    return out


def _embedding(rows: pd.DataFrame, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for column, weight in (("word_buckets", 2.0), ("gram_buckets", 1.0)):
        lengths = rows[column].map(len).to_numpy()
        if lengths.sum():
            np.add.at(out, (np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows[column].to_numpy())), weight)
    return out


def _common(left: pd.Series, right: pd.Series) -> dict:
    words = set().union(*left) & set().union(*right)
    return {w: i for i, w in enumerate(sorted(words))}


def _compare(tile: pd.DataFrame, cfg: MatchConfig) -> pd.DataFrame:
    left = tile[tile["side"] == 0].reset_index(drop=True)
    right = tile[tile["side"] == 1].reset_index(drop=True)
    diagonal = right.empty
    if diagonal:
        right = left
    if left.empty:
        return pd.DataFrame({"profile_a": [], "profile_b": [], "dice": [], "cosine": []})

    # Integer weights below 2**53 make these products exact in any order.
    codes = _common(left["words"], right["words"])
    weight = np.zeros(len(codes))
    for words, micros in zip(left["words"], left["micros"]):
        for w, m in zip(words, micros):
            if w in codes:
                weight[codes[w]] = m
    shared = (_token_matrix(left["words"], codes) * weight) @ _token_matrix(right["words"], codes).T
    tl, tr = left["total_micros"].to_numpy(float), right["total_micros"].to_numpy(float)
    both = np.add.outer(tl, tr)
    stated = np.outer(tl > 0, tr > 0)
    dice = np.where(stated, 2.0 * shared / np.where(both > 0, both, 1.0), 0.0)

    el, er = _embedding(left, cfg.dims), _embedding(right, cfg.dims)
    norm = lambda e: np.where((e * e).sum(1) > 0, np.sqrt((e * e).sum(1)), 1.0)
    cosine = np.where(stated, np.clip(el @ er.T / np.outer(norm(el), norm(er)), 0.0, 1.0), 0.0)

    hl = np.array([int(h, 16) if h else 0 for h in left["image_hash"]], dtype=np.uint64)
    hr = np.array([int(h, 16) if h else 0 for h in right["image_hash"]], dtype=np.uint64)
    known = np.outer(left["image_hash"] != "", right["image_hash"] != "")
    image = np.where(known, 1 - np.bitwise_count(np.bitwise_xor.outer(hl, hr)) / 64.0, 0.5)

    best = cfg.text * (0.5 * dice + 0.5 * cosine) + cfg.attribute + cfg.image * image
    keep = best >= cfg.similar - _SLACK
    pl, pr = left["profile_id"].to_numpy(), right["profile_id"].to_numpy()
    if diagonal:
        keep &= np.less.outer(pl, pr)
    # Outside one category only listings sharing a title token were candidates.
    cl, cr = left["category"].fillna("\0").to_numpy(), right["category"].fillna("\0").to_numpy()
    other = np.not_equal.outer(cl, cr)
    if other.any():
        names = _common(left["title_tokens"], right["title_tokens"])
        met = _token_matrix(left["title_tokens"], names) @ _token_matrix(right["title_tokens"], names).T > 0
        keep &= ~other | met
    i, j = np.nonzero(keep)
    return pd.DataFrame(
        {
            "profile_a": np.minimum(pl[i], pr[j]),
            "profile_b": np.maximum(pl[i], pr[j]),
            "dice": dice[i, j],
            "cosine": cosine[i, j],
        }
    )


def candidate_pairs(weighted: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(profile_a < profile_b, dice, cosine) for every pair that may be exact or similar."""
    blocks = _blocks(weighted, cfg.cell_rows)
    placed = weighted.join(
        blocks.withColumnsRenamed({"category_block": "_c", "brand_block": "_b"}),
        F.col("category_block").eqNullSafe(F.col("_c")) & F.col("brand_block").eqNullSafe(F.col("_b")),
    ).withColumn("_i", F.pmod(F.xxhash64("profile_id"), F.col("cells")).cast("int"))
    rows = placed.select(
        _cell("category_block", "brand_block", "_i").alias("cell"),
        "profile_id",
        "image_hash",
        "category",
        "title_tokens",
        F.coalesce(F.col("weights.token"), F.array().cast("array<string>")).alias("words"),
        F.coalesce(F.col("weights.micros"), F.array().cast("array<bigint>")).alias("micros"),
        F.coalesce("total_micros", F.lit(0)).alias("total_micros"),
        "word_buckets",
        "gram_buckets",
    )
    met = tiles(weighted, blocks).join(rows, "cell").drop("cell")
    return met.groupBy("tile").applyInPandas(lambda pdf: _compare(pdf, cfg), PAIR)
