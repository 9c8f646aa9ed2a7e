"""From baseline pairs to training rows: cleaning, flipping, discarding, resampling, mixing in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.functions import chat
from prefweave.functions.vectors import cosine, dot
from prefweave.operators.order import running_total, with_position
from prefweave.operators.select import beyond, selected
from prefweave.session import cut


def shuffle_key(seed: int, *parts: Column) -> Column:
    """An order that looks random and is the same in every engine: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def clean_pairs(df: DataFrame, key: str, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Valid pairs in a seeded order, numbered as ``row_index`` from 0; the first ``limit`` if given.

    ``key`` identifies a pair and isn't null. Only keys are ordered; the other columns are joined to the kept ones.
    """
    valid = df.where(chat.valid_pair(F.col("chosen"), F.col("rejected")))
    keys = valid.select(key, shuffle_key(seed, F.col(key)).alias("_h"))
    placed = with_position(keys, [F.col("_h"), F.col(key)], "row_index").drop("_h")
    kept = placed if limit is None else placed.where(F.col("row_index") < limit)
    return valid.join(kept, key).select(*df.columns, "row_index")


def normalized(df: DataFrame, position: str, force_new: bool = False) -> DataFrame:
    """Lineage columns of training rows.

    ``original_index`` defaults to the position and ``mask`` to 1; a new row (-1) has mask 1; any
    other mask of a reused row is an error. ``force_new`` makes every row new.
    """
    own = lambda c, default: F.coalesce(F.col(c), default) if c in df.columns else default
    if force_new:
        original, mask = F.lit(-1), F.lit(1)
    else:
        original = own("original_index", F.col(position))
        mask = own("mask", F.lit(1))
        mask = F.when(original == -1, 1).when(mask.isin(-1, 1), mask).otherwise(F.raise_error(F.concat(F.lit("mask of a reused row must be 1 or -1, not "), mask.cast("string"))))
    return df.withColumns({"original_index": original.cast("bigint"), "mask": mask.cast("int"), "new_index": F.lit(-1).cast("bigint")})


def flipped_mask(swap: Column) -> Column:
    """The mask after a flip: negated of a reused row, 1 of a new one."""
    return F.when(swap & (F.col("original_index") >= 0), -F.col("mask")).when(swap, 1).otherwise(F.col("mask"))


def flipped(df: DataFrame, where: Column) -> DataFrame:
    """Sides exchanged where asked, and the mask of reused rows negated."""
    swap = F.coalesce(where, F.lit(False))
    return df.withColumns({
        "chosen": F.when(swap, F.col("rejected")).otherwise(F.col("chosen")),
        "rejected": F.when(swap, F.col("chosen")).otherwise(F.col("rejected")),
        "mask": flipped_mask(swap),
    })


def signed_score(score: Column, was_flipped: Column) -> Column:
    return F.when(F.coalesce(was_flipped, F.lit(False)), -score).otherwise(score)


def resampled(df: DataFrame, position: str, key: str, target: int | None, seed: int, shuffle_first: bool = False) -> DataFrame:
    """``df`` brought to ``target`` rows, with ``output_pos`` from 0.

    Fewer: the first of a seeded order. More: all rows in their own order once, then whole
    seeded orders, a fresh one for each pass, until the target is reached. ``shuffle_first`` gives
    the first pass a seeded order too. None keeps all rows as they are. A negative target,
    or a positive one for no rows, is an error.
    """
    if target is not None and target < 0:
        raise ValueError("the target can't be negative")
    if target is None:
        return with_position(df, [F.col(position), F.col(key)], "output_pos")
    if target == 0:
        return df.withColumn("output_pos", F.lit(0).cast("bigint")).where(F.lit(False))
    df = cut(df)
    n = df.count()
    if not n:
        raise ValueError("no rows to reach a positive target with")
    if not shuffle_first and target == n:
        return with_position(df, [F.col(position), F.col(key)], "output_pos")
    passes = -(-target // n)
    own_first = passes > 1 and not shuffle_first
    copies = df.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    order = shuffle_key(seed, F.col("_pass"), F.col(key))
    if own_first:
        order = F.when(F.col("_pass") == 0, F.lpad(F.col(position).cast("string"), 20, "0")).otherwise(order)
    placed = with_position(copies.withColumn("_h", order), [F.col("_pass"), F.col("_h"), F.col(key)], "output_pos")
    return placed.where(F.col("output_pos") < target).drop("_pass", "_h")


def finalized(df: DataFrame) -> DataFrame:
    """``new_index`` counts the new rows in output order; reused rows have -1."""
    new = df.withColumn("_new", (F.col("original_index") == -1).cast("bigint"))
    counted = running_total(new, [F.col("output_pos")], "_new", "_n")
    return counted.withColumn("new_index", F.when(F.col("_new") == 1, F.col("_n")).otherwise(-1).cast("bigint")).drop("_new", "_n")


def extra_rows(df: DataFrame, key: str, size: int | None, seed: int) -> DataFrame:
    """Chosen and rejected of ``size`` extra rows in seeded order, all of them new; with ``output_pos``."""
    keys = df.select(F.col(key).alias("_key"))
    drawn = resampled(keys, "_key", "_key", size, seed, shuffle_first=size is not None)
    rows = drawn.join(df.select(F.col(key).alias("_key"), "chosen", "rejected"), "_key").drop("_key")
    return normalized(rows, "output_pos", force_new=True)


def training_rows(source: DataFrame, key: str, selected_flag: str, action: str, target: int | None = None, seed: int = 42, extra: DataFrame | None = None, extra_size: int | None = None, always_discard: str | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Training rows from a selection: selected rows discarded or flipped, resampled, extras after them.

    The flag of ``always_discard`` drops rows before anything else. The target counts the extras, of
    which ``extra_size`` are drawn from ``extra`` (with the same key column) in seeded order. Key,
    score and lineage columns stay; ``output_pos`` gives the order. Only keys and flags are
    ordered and resampled; the chats are joined to the result. They come from ``payload`` (by the
    key) if given; then they needn't be in ``source``, and are read once.
    """
    if action not in ("discard", "flip"):
        raise ValueError(f"action must be discard or flip, not {action}")
    chats = ("chosen", "rejected")
    kept = source.drop(*chats)
    if always_discard is not None:
        kept = kept.where(~F.coalesce(F.col(always_discard), F.lit(False)))
    if action == "discard":
        kept = kept.where(~F.coalesce(F.col(selected_flag), F.lit(False)))
    rows = normalized(kept, key).withColumns({"_extra": F.lit(False), "_flip": F.coalesce(F.col(selected_flag), F.lit(False)) if action == "flip" else F.lit(False)})
    rows = rows.withColumn("mask", flipped_mask(F.col("_flip")))
    payload = (source if payload is None else payload).select(key, *chats, F.lit(False).alias("_extra"))
    new, n_extra = None, 0
    if extra is not None:
        drawn = resampled(extra.select(key), key, key, extra_size, seed, shuffle_first=extra_size is not None)
        new = cut(normalized(drawn, "output_pos", force_new=True).withColumns({"_extra": F.lit(True), "_flip": F.lit(False)}))
        n_extra = new.count()
        payload = payload.unionByName(extra.select(key, *chats, F.lit(True).alias("_extra")))
    if target is not None and target < n_extra:
        raise ValueError("there are more extra rows than the target allows")
    base = resampled(rows, key, key, None if target is None else target - n_extra, seed)
    if new is not None:
        base = cut(base)
        start = base.count()
        base = base.unionByName(new.withColumn("output_pos", F.col("output_pos") + start), allowMissingColumns=True)
    placed = finalized(base).join(payload, [key, "_extra"])
    side = lambda a, b: F.when(F.col("_flip"), F.col(b)).otherwise(F.col(a))
    return placed.withColumns({"chosen": side(*chats), "rejected": side(*reversed(chats))}).drop("_extra", "_flip")


def kept_score_stats(rows: DataFrame, score: str) -> DataFrame:
    """Count, sum and mean of the scores that stay; 0 where there are none."""
    return rows.agg(F.count(score).alias("n_scores"), F.coalesce(F.sum(score), F.lit(0.0)).alias("sum_score"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))


def filter_by_vector(source: DataFrame, key: str, diffs: DataFrame, vector: Column, method: str = "cosine", action: str = "discard", target: int | None = None, seed: int = 42, extra: DataFrame | None = None, extra_size: int | None = None, payload: DataFrame | None = None, **ends: float | None) -> DataFrame:
    """Training rows by similarity of each row's ``diff`` to a direction; ``score`` is signed after a flip.

    Every source row needs a diff: a missing one, or one without a source row, is an error.
    """
    if method not in ("cosine", "dot"):
        raise ValueError(f"method must be cosine or dot, not {method}")
    similarity = (cosine if method == "cosine" else dot)(F.col("diff"), vector)
    scores = diffs.select(key, similarity.alias("score"), F.lit(True).alias("_scored"))
    joined = cut(source.select(key, F.lit(True).alias("_has")).join(scores, key, "full_outer"))
    if joined.where("_has is null or _scored is null").limit(1).count():
        raise ValueError("source rows and similarities don't match")
    flags = selected(joined.drop("_has", "_scored"), "score", **ends)
    rows = training_rows(source.join(flags, key), key, "selected", action, target, seed, extra, extra_size, payload=payload)
    if action == "flip":
        rows = rows.withColumn("score", signed_score(F.col("score"), F.col("selected")))
    return rows


def filter_by_logprob(source: DataFrame, key: str, scores: DataFrame, action: str = "discard", target: int | None = None, seed: int = 42, extra: DataFrame | None = None, extra_size: int | None = None, payload: DataFrame | None = None, **ends: float | None) -> DataFrame:
    """Training rows by log-probability score; skipped rows are always discarded and don't count in shares."""
    skipped = F.coalesce("skip", F.lit(False))
    flags = selected(scores.select(key, skipped.alias("skipped"), F.when(~skipped, F.col("score")).alias("score")), "score", **ends)
    return training_rows(source.join(flags, key), key, "selected", action, target, seed, extra, extra_size, always_discard="skipped", payload=payload)


def filter_by_rating(rated: DataFrame, key: str, threshold: int, direction: str = "above", action: str = "discard", target: int | None = None, seed: int = 42, extra: DataFrame | None = None, extra_size: int | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Training rows by a judge's rating; rows without one are never selected."""
    flagged = rated.withColumn("selected", beyond(F.col("autorater_score"), threshold, direction))
    return training_rows(flagged, key, "selected", action, target, seed, extra, extra_size, payload=payload)
