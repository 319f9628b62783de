"""Composite indicators (CI1–CI19) built from the operators.

These work on entity-level tables (one row per place or region). Statistics
are one aggregate each (broadcast one-row joins); medians are exact and
computed for all columns in one sort by unpivoting first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_float, to_bool, tri_state
from ..functions.rowwise import row_mean, row_weighted_mean
from ..functions.stats import clip
from ..operators.agg import fill_half_min, quantile_exact
from ..operators.joins import join_all
from ..operators.rank import rank_columns, rank_min, row_rank
from ..session import cut_lineage
from ..operators.scale import percent_of_max, scale, scale_many

# Words in parking notes that signal an uncertain figure (CI4).
UNCERTAIN_WORDS = ["약", "이상", "잘모르겠", "추정", "approximately", "about"]
# Pillar weights of the overall score (CI18).
PILLAR_WEIGHTS = {"LEI": 2, "ACC": 2, "SAF": 3, "NAT": 3}
# Safety sub-pillar weights (CI14).
SAFETY_WEIGHTS = {"CRI": 0.2, "DRM": 0.25, "TRA": 0.25, "FIR": 0.1, "MED": 0.1, "RST": 0.1}
# Radius weights of the accessibility total (CI6/CI7).
RADIUS_WEIGHTS = {500: 0.6, 1000: 0.3, 2000: 0.1}


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of every column (null when all missing).

    Columns are unpivoted into (name, value) so a single sort serves all of them.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v"))
                                         for c in cols])).alias("_p")).select("_p.*")
    # values of entities, written once: the passes of the selection read the same numbers
    q = quantile_exact(cut_lineage(long), "_v", {"_med": 0.5}, by="_name")
    wide = q.groupBy().pivot("_name", cols).agg(F.first("_med"))
    # a column without any value has no group: keep the one-row shape
    base = df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"_m_{c}") for c in cols])
    return base.crossJoin(wide).select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(f"{c}__median")
                                         if c in wide.columns else F.col(f"_m_{c}").alias(f"{c}__median")
                                         for c in cols])


def weighted_composite(df: DataFrame, weights: dict[str, float], out: str, impute: str = "median",
                       all_missing: float | None = 0.0) -> DataFrame:
    """CI1/CI2: Σ w·x with each input filled by its median; when an input has no
    value at all its fill is ``all_missing`` (0 in CI1; None leaves the total
    missing, CI2)."""
    return weighted_composites(df, {out: weights}, impute, all_missing)


def weighted_composites(df: DataFrame, specs: dict[str, dict[str, float]], impute: str = "median",
                        all_missing: float | dict | None = 0.0) -> DataFrame:
    """Several CI1/CI2 totals (``{out: {col: weight}}``) with one median pass; ``all_missing`` may
    differ by total (``{out: fill}``)."""
    if impute != "median":
        raise ValueError("only median imputation is used")
    cols = list(dict.fromkeys(c for w in specs.values() for c in w))
    med = medians(df, cols)
    j = df.crossJoin(F.broadcast(med))
    totals = {}
    for out, weights in specs.items():
        total = None
        for c, w in weights.items():
            fillv = F.col(f"{c}__median")
            none = all_missing.get(out) if isinstance(all_missing, dict) else all_missing
            if none is not None:
                fillv = F.coalesce(fillv, F.lit(float(none)))
            term = F.coalesce(F.col(c).cast("double"), fillv) * F.lit(float(w))
            total = term if total is None else total + term
        totals[out] = total
    return j.withColumns(totals).drop(*[f"{c}__median" for c in cols])


def representative_minutes(df: DataFrame, final: str, parts: list[list[str]], out: str = "final_walk_min") -> DataFrame:
    """CI3: the final value when present, else the mean of the available parts, each
    part being the first present key of its priority list."""
    firsts = [F.coalesce(*[F.col(k).cast("double") for k in keys]) for keys in parts]
    return df.withColumn(out, F.coalesce(F.col(final).cast("double"), row_mean(firsts)))


def parking_score(df: DataFrame, has: str, lots: str, spaces: str, accessible_only: str,
                  external: str, notes: str | None, out: str = "parking_score") -> DataFrame:
    """CI4: base by tri-state flag (false 0, or 20 with an external lot; true 20;
    unknown 10) + 8 per lot up to 5 + 40·min(spaces, 1000)/1000; capped at 40 when
    only accessible spaces exist; ×0.9 when notes hold an uncertainty word; clip 0–100."""
    flag = tri_state(F.col(has))
    ext = to_bool(F.col(external))
    base = (F.when(flag == F.lit(False), F.when(ext, F.lit(20.0)).otherwise(F.lit(0.0)))
            .when(flag == F.lit(True), F.lit(20.0)).otherwise(F.lit(10.0)))
    lv = safe_float(F.col(lots))
    sv = safe_float(F.col(spaces))
    lots_pts = F.when(lv.isNotNull(), clip(lv, 0.0, 5.0) * 8.0).otherwise(F.lit(0.0))
    sp_pts = F.when(sv.isNotNull(), clip(sv, 0.0, 1000.0) / 1000.0 * 40.0).otherwise(F.lit(0.0))
    score = base + lots_pts + sp_pts
    score = F.when(to_bool(F.col(accessible_only)), F.least(score, F.lit(40.0))).otherwise(score)
    if notes:
        dt = dict(df.dtypes)[notes]
        txt = F.coalesce(F.array_join(F.col(notes), " ") if dt.startswith("array") else F.col(notes).cast("string"),
                         F.lit(""))
        uncertain = reduce(lambda a, b: a | b, [F.instr(txt, w) > 0 for w in UNCERTAIN_WORDS])
        score = F.when(uncertain, score * 0.9).otherwise(score)
    return df.withColumn(out, clip(score, 0.0, 100.0))


def region_scores(df: DataFrame, region: str, components: list[str], totals: list[str]) -> DataFrame:
    """CI5: per region the component means and, per total, the mean and max with
    competition ranks (descending)."""
    aggs = [F.avg(c).alias(f"{c}_mean") for c in components]
    for t in totals:
        aggs += [F.avg(t).alias(f"{t}_mean"), F.max(t).alias(f"{t}_max")]
    g = df.filter(F.col(region).isNotNull() & (F.col(region) != "")).groupBy(region).agg(*aggs)
    g = cut_lineage(g)
    specs = {}
    for t in totals:
        specs[f"{t}_mean"] = f"{t}_mean_rank"
        specs[f"{t}_max"] = f"{t}_max_rank"
    return rank_columns(g, region, specs)


def access_final(df: DataFrame, key: str, pop_cols: dict, walk: str, park: str,
                 walk_w: float, park_w: float, pop_w: float, radius_weights: dict | None = None,
                 by: str | None = None, eps: float = 0.5, sharp: float = 1.0) -> DataFrame:
    """CI6: per radius total = pop_r·pop_w + walk·walk_w + park·park_w (each filled by
    its median; a column without values leaves the total missing), the radius-weighted
    mean of the totals (renormalised over present radii), the z-CDF margin score
    (SC8) and its competition rank. With ``by`` the components are first averaged per
    group (e.g. district) and the group becomes the key."""
    rw = radius_weights or RADIUS_WEIGHTS
    base = df
    if by:
        base = cut_lineage(df.filter(F.col(by).isNotNull() & (F.col(by) != ""))
                           .groupBy(by).agg(*[F.avg(c).alias(c) for c in [walk, park, *pop_cols.values()]]))
        key = by
    comps = [walk, park, *pop_cols.values()]
    med = medians(base, comps)  # one sort for all component medians
    base = base.crossJoin(F.broadcast(med))

    def filled(c):
        return F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median"))
    totals = {f"total_{r}m": rw[r] for r in pop_cols}
    base = base.withColumns({f"total_{r}m": filled(c) * pop_w + filled(walk) * walk_w + filled(park) * park_w
                             for r, c in pop_cols.items()})
    base = base.drop(*[f"{c}__median" for c in comps])
    base = cut_lineage(base.withColumn("total", row_weighted_mean(totals)))
    base = scale(base, "total", "total_100", "zcdf_margin", eps=eps, sharp=sharp, constant=50.0, all_missing=50.0,
                 degenerate_all_rows=True)
    return rank_min(cut_lineage(base), "total_100", "rank")


def population_score(df: DataFrame, key: str, pop_cols: dict, region: str | None = None,
                     radius_weights: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """CI7: radius-weighted population score (renormalised), missing → half the minimum,
    z-CDF ×100 (constant → 50), sequential rank; optionally the mean standardised
    score per region with its own sequential rank."""
    rw = radius_weights or RADIUS_WEIGHTS
    s = df.withColumn("pop_weighted", row_weighted_mean({c: rw[r] for r, c in pop_cols.items()}))
    s = fill_half_min(s, "pop_weighted")
    s = scale(s, "pop_weighted", "pop_weighted_std", "zcdf", constant=50.0, degenerate_all_rows=True)
    s = cut_lineage(s)
    ranked = row_rank(s, "pop_weighted_std", "rank_pop", tiebreak=key)
    if not region:
        return ranked, None
    d = s.filter(F.col(region).isNotNull()).groupBy(region).agg(F.avg("pop_weighted_std").alias("pop_weighted_std_mean"))
    return ranked, row_rank(cut_lineage(d), "pop_weighted_std_mean", "rank_pop_region", tiebreak=region)


# ---------------------------------------------------------------- safety (CI8–CI14)

def crime_score(big5_occ: Column, big5_arrest: Column, cctv: Column) -> Column:
    """CI8: .7·mean(occurrence, arrest) + .3·CCTV."""
    return 0.7 * ((big5_occ + big5_arrest) / 2) + 0.3 * cctv


def disaster_score(pair: list[Column], quad: list[Column]) -> Column:
    """CI9: .5·mean of the two supply indicators + .5·mean of the four shelters."""
    return 0.5 * (reduce(lambda a, b: a + b, pair) / len(pair)) + 0.5 * (reduce(lambda a, b: a + b, quad) / len(quad))


def shelter_indicator(count_score: Column, capacity_score: Column) -> Column:
    """CI9 shelter: .4 count + .6 capacity."""
    return 0.4 * count_score + 0.6 * capacity_score


def fire_score(count_score: Column, share_score: Column) -> Column:
    """CI10: mean of the station-count score and the type-share score."""
    return row_mean([count_score, share_score])


def medical_score(inst: Column, pharm: Column, phc: Column) -> Column:
    """CI11: .5 institutions + .25 pharmacies + .25 health centres."""
    return 0.5 * inst + 0.25 * pharm + 0.25 * phc


def rest_score(climate: Column, cold: Column, heat: Column, library: Column) -> Column:
    """CI12: .4 climate + .4 cold + .1 heat + .1 library shelters."""
    return 0.4 * climate + 0.4 * cold + 0.1 * heat + 0.1 * library


def traffic_score(safety_idx: Column, accident: Column, congestion: Column) -> Column:
    """CI13: .6 safety-index risk + .3 accident + .1 congestion (as the code adds them)."""
    return 0.6 * safety_idx + 0.3 * accident + 0.1 * congestion


def station_congestion(df: DataFrame, station: str, places: DataFrame, place_station: str, district: str,
                       mark: str = "시", out: str = "station_mean_congest", score: str = "congestion_score") -> DataFrame:
    """CI13 input: a row's mean over its time-slot columns (those whose name holds ``mark``), the
    station's districts from the distinct (district, station) pairs of ``places``, and the mean per
    district, min-max scaled to 0-100. Rows without a district or without slots are left out."""
    slots = [c for c in df.columns if mark in c]
    means = df.select(station, row_mean([F.col(c) for c in slots]).alias(out))
    pairs = places.select(F.col(district), F.col(place_station).alias(station)).distinct()
    told = means.join(pairs, station).where(F.col(district).isNotNull()).groupBy(district).agg(F.avg(out).alias(out))
    return scale(cut_lineage(told), out, score, "minmax", constant=0.0)


def safety_index(pillars: dict[str, DataFrame], key: str, domain: DataFrame,
                 weights: dict[str, float] | None = None, out: str = "safety_score") -> DataFrame:
    """CI14: every pillar (key, ``{name}_score``) completed over the domain with its own
    median (JN7; extra members kept), inner-joined on the key, weighted sum.

    Done in one pass: the pillars are stacked long (key, pillar, score), one
    aggregate gives every pillar's median, one full join against domain × pillar
    names completes them, and one pivot brings them back side by side.
    """
    w = weights or SAFETY_WEIGHTS
    names = list(pillars)
    long = None
    for n, df in pillars.items():
        part = df.select(key, F.lit(n).alias("_pillar"), F.col(f"{n}_score").cast("double").alias("_score"))
        long = part if long is None else long.unionByName(part)
    long = cut_lineage(long)  # one reading of the scores for the medians and the rows
    med = quantile_exact(long, "_score", {"_med": 0.5}, by="_pillar")
    pn = domain.sparkSession.createDataFrame([(n,) for n in names], "_pillar string")
    frame = domain.select(key).distinct().crossJoin(F.broadcast(pn))  # domain × a literal list
    full = frame.join(long, [key, "_pillar"], "full").join(F.broadcast(med), "_pillar", "left")
    full = full.withColumn("_score", F.coalesce(F.col("_score"), F.col("_med"))).withColumn("_hit", F.lit(1))
    # a (key, pillar) row exists when the key is in the domain or in that pillar; keys
    # lacking a row for some pillar drop out, as the inner join of completed pillars does
    wide = full.groupBy(key).pivot("_pillar", names).agg(F.first("_score").alias("s"), F.max("_hit").alias("h"))
    present = reduce(lambda a, b: a & b, [F.col(f"{n}_h").isNotNull() for n in names])
    wide = wide.filter(present).select(key, *[F.col(f"{n}_s").alias(f"{n}_score") for n in names])
    total = reduce(lambda a, b: a + b, [F.lit(float(w[n])) * F.col(f"{n}_score") for n in names])
    return wide.withColumn(out, total)


def equal_subindex(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """CI15: every metric whose name starts with ``prefix`` min-max scaled to 0–1,
    then their plain mean."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    s = scale_many(df, [dict(c=c, out=f"{c}__n", method="minmax", top=1.0, constant=0.0) for c in cols])
    return s.withColumn(out, row_mean([f"{c}__n" for c in cols])).drop(*[f"{c}__n" for c in cols])


def leisure_total(a: DataFrame, b: DataFrame, key: str, a_col: str, b_col: str,
                  out: str = "leisure_score") -> DataFrame:
    """CI16: outer join, missing → 0, T-score (sample σ, constant → 50) of each,
    equal-weight mean."""
    j = a.select(key, a_col).join(b.select(key, b_col), key, "full").fillna(0.0, subset=[a_col, b_col])
    j = scale_many(j, [dict(c=a_col, out=f"{a_col}_t", method="tscore", ddof=1, constant=50.0, degenerate_all_rows=True),
                       dict(c=b_col, out=f"{b_col}_t", method="tscore", ddof=1, constant=50.0, degenerate_all_rows=True)])
    return j.withColumn(out, 0.5 * F.col(f"{a_col}_t") + 0.5 * F.col(f"{b_col}_t"))


def nature_score(df: DataFrame, key: str, confidence: str, size: str, name: str | None = None,
                 keywords: list[str] | None = None, out: str = "eco_score") -> DataFrame:
    """CI17: Σ confidence × topic size per place, z-CDF ×100 (population σ) and a
    sequential rank. The keyword weight (count of keyword hits in the topic name, 0.1
    when none) is reported per place as ``topic_weight`` but, as in the reference,
    not applied."""
    from ..functions.text import keyword_regex
    s = df.withColumn("_eco", F.col(confidence).cast("double") * F.col(size).cast("double"))
    aggs = [F.coalesce(F.sum("_eco"), F.lit(0.0)).alias(out)]
    if name and keywords:
        cnt = F.regexp_count(F.coalesce(F.col(name), F.lit("")), F.lit(keyword_regex(keywords)))
        s = s.withColumn("_tw", F.when(cnt == 0, F.lit(0.1)).otherwise(cnt.cast("double")))
        aggs.append(F.sum("_tw").alias("topic_weight"))
    g = s.groupBy(key).agg(*aggs)
    g = scale(g, out, f"{out}_std", "zcdf", constant=50.0, degenerate_all_rows=True)
    return row_rank(cut_lineage(g), out, "rank", tiebreak=key)


def overall_score(pillars: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """CI18: outer join of the pillar scores (missing → 0), Σ w·score, percent of the
    theoretical maximum (SC12), z with sample σ (0 when constant) and sigmoid ×100."""
    w = weights or PILLAR_WEIGHTS
    frames = [df.select(key, F.col(f"{n}_score").cast("double").alias(f"{n}_score")) for n, df in pillars.items()]
    j = join_all(frames, key, "full").fillna(0.0)
    raw = reduce(lambda a, b: a + b, [F.col(f"{n}_score") * F.lit(float(w[n])) for n in pillars])
    j = j.withColumn("raw_total", raw).withColumn("score_theoretical", percent_of_max("raw_total", sum(w[n] for n in pillars)))
    return scale(j, "raw_total", "score_z_transformed", "sigmoid", ddof=1, z_out="z_score")


def map_layer(dim: DataFrame, scores: DataFrame, dim_key: str, score_key: str, value: str,
              name_map: dict | None = None) -> DataFrame:
    """CI19 (table part): boundary attributes left-joined with scores (keys optionally
    translated by ``name_map``), with the shared display value (SC13)."""
    from ..functions.text import apply_map
    from ..operators.scale import display_scale
    s = scores
    if name_map:
        s = s.withColumn(score_key, apply_map(F.col(score_key), name_map, keep_unmapped=False))
    j = dim.join(s.withColumnRenamed(score_key, dim_key), dim_key, "left")
    return display_scale([j], value)[0]
