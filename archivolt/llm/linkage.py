"""Matching listings and products that share no key: soft-logic linkage.

Candidates are pairs of distinct attribute signatures of one model whose kinds do not differ. Each pair is a truth value in
[0, 1]; weighted rules make a convex hinge-loss problem:

  agreement      an attribute on which both sides agree supports the link, one that one side lacks a little
  contradiction  an attribute on which they differ speaks against it
  prior          a link needs support
  exclusivity    a listing is linked to one product at most (sum <= 1)
  transitivity   listings linked to one product agree with each other in what the product row leaves open:
                 link(l, s) -> value(s, v) for the listing's value v, and a product has one value (sum <= 1)

It is solved by consensus alternating directions (ADMM). The problem falls apart into blocks of one model;
blocks are spread over tasks by hash, and each task iterates over all factors of its blocks at once.
Rows never enter it: a block holds distinct signatures only, whose number the attribute lexicons bound, so
copies and hot products cost nothing. The final truth value is the match's confidence.

Defined results: listings and products without a model are not linked; one without a kind may be of any; a tie between
two products leaves both at one half and gives no link; repeated rows are linked alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.products import ATTRIBUTES, brands_of, compatible, listings_and_kinds, parse, same_sizes, signature
from archivolt.session import materialize

OPEN = ("brand", "color", "season", "measure")
AGREE = {"brand": 1.0, "color": 1.0, "season": 1.0, "measure": 1.0}
LACKING, AGAINST, PRIOR, IMPLIES = 0.3, 5.0, 0.6, 3.0
#: pairs in one task, about
BUCKET = 40_000


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of signatures of one model, kinds not differing, with at most one contradiction."""
    l, r = left.alias("l"), right.alias("r")
    differ = sum((F.coalesce((F.col(f"l.{c}") != F.col(f"r.{c}")), F.lit(False)).cast("int") for c in OPEN), F.lit(0))
    pairs = l.join(r, (F.col("l.model") == F.col("r.model")) & compatible("l", "r", ("kind",))).filter(differ <= 1)
    return pairs.select(F.col("l.model").alias("block"), F.col("l.sig").alias("lid"), F.col("r.sku").alias("sku"), *[F.col(f"l.{c}").alias(f"l_{c}") for c in OPEN], *[F.col(f"r.{c}").alias(f"r_{c}") for c in OPEN])


def admm(pairs: pd.DataFrame, steps: int = 200, rho: float = 1.0, tolerance: float = 1e-4) -> np.ndarray:
    """Truth values of the pairs; all blocks at once."""
    n = len(pairs)
    support = np.full(n, -PRIOR)
    hubs, hub_edges = [], []
    for c in OPEN:
        a, b = pairs[f"l_{c}"], pairs[f"r_{c}"]
        both = (a.notna() & b.notna()).to_numpy()
        same = (a == b).to_numpy()
        support += np.where(both & same, AGREE[c], np.where(both, -AGAINST, LACKING))
        open_ = (a.notna() & b.isna()).to_numpy()
        if open_.any():
            at = np.flatnonzero(open_)
            key = pairs["sku"].to_numpy()[at].astype(str) + "\x00" + c + "\x00" + a.to_numpy()[at].astype(str)
            owner = pairs["sku"].to_numpy()[at].astype(str) + "\x00" + c
            values, index = np.unique(key, return_inverse=True)
            first_at = np.unique(index, return_index=True)[1]
            hubs.append(owner[first_at])
            hub_edges.append((at, index))
    # variables: links, then 'product s has value v'
    n_hub = sum(len(h) for h in hubs)
    m = n + n_hub
    base, implied_x, implied_y = n, [], []
    for h, (at, index) in zip(hubs, hub_edges):
        implied_x.append(at)
        implied_y.append(base + index)
        base += len(h)
    ix = np.concatenate(implied_x) if implied_x else np.zeros(0, int)
    iy = np.concatenate(implied_y) if implied_y else np.zeros(0, int)
    owners = np.unique(np.concatenate(hubs), return_inverse=True)[1] if hubs else np.zeros(0, int)
    listing = np.unique(pairs["lid"].to_numpy().astype(str), return_inverse=True)[1]
    # local copies: support (each link), sum of a listing, implications (two variables), sum of a product's values
    var = np.concatenate([np.arange(n), np.arange(n), ix, iy, np.arange(n, m)])
    k = len(ix)
    s0, s1, s2, s3, s4 = n, 2 * n, 2 * n + k, 2 * n + 2 * k, 2 * n + 2 * k + n_hub
    degree = np.maximum(np.bincount(var, minlength=m), 1)
    x, u, z = np.full(s4, 0.5), np.zeros(s4), np.full(m, 0.5)
    count_l = np.maximum(np.bincount(listing, minlength=1), 1)
    count_h = np.maximum(np.bincount(owners, minlength=1), 1)
    for _ in range(steps):
        v = z[var] - u
        x[:s0] = v[:s0] + support / rho
        over = np.maximum(np.bincount(listing, weights=v[s0:s1], minlength=len(count_l)) - 1, 0) / count_l
        x[s0:s1] = v[s0:s1] - over[listing]
        if k:
            gap = v[s1:s2] - v[s2:s3]  # hinge max(0, x - y)
            move = np.clip(gap / 2, 0, IMPLIES / rho)
            x[s1:s2], x[s2:s3] = v[s1:s2] - move, v[s2:s3] + move
            over = np.maximum(np.bincount(owners, weights=v[s3:s4], minlength=len(count_h)) - 1, 0) / count_h
            x[s3:s4] = v[s3:s4] - over[owners]
        old, z = z, np.clip(np.bincount(var, weights=x + u, minlength=m) / degree, 0, 1)
        u += x - z[var]
        np.clip(u, -20, 20, out=u)
        if np.abs(z - old).max(initial=0) < tolerance and np.abs(x[s0:] - z[var][s0:]).max(initial=0) < 1e-2:
            break
    return z[:n]


def solve(pairs: DataFrame) -> DataFrame:
    """(lid, sku, confidence) of all candidate pairs."""
    pairs = materialize(pairs)
    buckets = max(1, -(-pairs.count() // BUCKET))

    def of(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lid": f["lid"], "sku": f["sku"], "confidence": admm(f)})

    return pairs.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))).groupBy("bucket").applyInPandas(of, "lid string, sku string, confidence double")


def link(products: DataFrame, skus: DataFrame) -> DataFrame:
    """(meta_id, sku, confidence) of every linked listing."""
    brands = brands_of(products, skus)
    rows, kinds = listings_and_kinds(products, brands)
    known = parse(skus, "sku", brands, season="season", kinds=kinds).withColumn("model", F.col("name_model")).select("sku", *ATTRIBUTES).filter("model is not null")
    rows, known = same_sizes(rows, materialize(known))
    rows = rows.withColumn("sig", signature())
    left = rows.filter("model is not null").select("sig", *ATTRIBUTES).distinct()
    solved = solve(candidates(left, known))
    best = solved.filter("confidence > 0.6").groupBy(F.col("lid").alias("sig")).agg(F.max_by("sku", F.struct("confidence", "sku")).alias("sku"), F.round(F.max("confidence"), 4).alias("confidence"))
    return rows.select("meta_id", "sig").join(best, "sig").select("meta_id", "sku", "confidence")
