"""Workspace labelling (business unit and environment)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmix.functions.exprs import multi_select
from jobmix.functions.rules import ENV_RULES, Rule, label_expr
from jobmix.operators.joins import dimension_join
from jobmix.params import UNMAPPED, Params


def label_by_rules(df: DataFrame, name_col: str, rules: Sequence[Rule], out: str,
                   default: str = UNMAPPED) -> DataFrame:
    """Add ``out`` = first matching rule's label for ``name_col`` (else ``default``)."""
    return df.withColumn(out, label_expr(F.col(name_col), rules, default))


def workspace_labels(workspaces: DataFrame, bu_rules: Sequence[Rule],
                     env_rules: Sequence[Rule] = ENV_RULES) -> DataFrame:
    """The workspace dimension: id, name, bu, env (one pass, narrow)."""
    name = F.col("workspace_name")
    return workspaces.select(
        "workspace_id", "workspace_name",
        label_expr(name, bu_rules).alias("bu"),
        label_expr(name, env_rules).alias("env"),
    )


def label_from_tag(df: DataFrame, tag: str, out: str = "bu", tags_col: str = "custom_tags",
                   default: str = UNMAPPED) -> DataFrame:
    """Take the label from a resource tag instead of the workspace name.

    A missing key (or a NULL map) gives ``default``.
    """
    value = F.try_element_at(F.col(tags_col), F.lit(tag))
    return df.withColumn(out, F.coalesce(value, F.lit(default)))


def attach_labels(df: DataFrame, ws: DataFrame, params: Params | None = None,
                  use_env: bool = True, drop_unmapped_bu: bool = False,
                  with_name: bool = True, keep_bu: bool = False) -> DataFrame:
    """Attach ``bu``, ``env`` (and ``workspace_name``) by ``workspace_id``; filter.

    A workspace missing from the dimension is labelled Unmapped and named by
    its id.  ``ws`` is the small labelled workspace dimension, broadcast when
    its size estimate fits.  ``params`` applies the BU choices and, with
    ``use_env``, the environment choices.  ``keep_bu`` keeps the rows' own
    ``bu`` instead of the workspace's.
    """
    dim = ws.select(F.col("workspace_id").alias("_ws_id"),
                    F.col("workspace_name").alias("_ws_name"),
                    F.col("bu").alias("_ws_bu"), F.col("env").alias("_ws_env"))
    joined = dimension_join(df, dim, df["workspace_id"] == dim["_ws_id"], "left")
    labels = [df["bu"] if keep_bu else F.coalesce("_ws_bu", F.lit(UNMAPPED)).alias("bu"),
              F.coalesce("_ws_env", F.lit(UNMAPPED)).alias("env")]
    if with_name:
        labels.append(F.coalesce("_ws_name", df["workspace_id"]).alias("workspace_name"))
    out = joined.select(*[c for c in df.columns if c not in ("bu", "env", "workspace_name")], *labels)
    if drop_unmapped_bu:
        out = out.where(F.col("bu") != F.lit(UNMAPPED))
    if params is not None:
        out = out.where(multi_select("bu", params.bu))
        if use_env:
            out = out.where(multi_select("env", params.env))
    return out
