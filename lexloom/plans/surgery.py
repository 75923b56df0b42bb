"""Changes to a whole model's tensors (name, r, values): new token numbers, experts, text model alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tensors as T

#: Names of the text model within a multimodal one, and of the other modalities' parts. Fixed values.
LANGUAGE, OTHERS = r"^model\.language_model\.", r"\.(audio_tower|vision_tower|embed_audio|embed_vision)\."


def reindex_model(tensors: DataFrame, names: list[str], mapping: DataFrame, size: int, width: int, added: DataFrame | None = None, text_only: bool = False) -> DataFrame:
    """The named matrices (embeddings, output head) with their rows at new numbers (mapping: old_id, new_id),
    `size` of them, zeros where nothing maps; rows of `added` (new_id, old_id) are the mean of old rows. All
    other tensors stay. text_only: other modalities' tensors go, the text model's lose their prefix."""
    done = tensors.filter(~F.col("name").isin(names))
    for name in names:
        rows = tensors.filter(F.col("name") == name).select("r", "values")
        out = T.reindex_rows(rows, mapping, size, width)
        if added is not None:
            new = T.added_rows(rows, added).select("r", F.col("values").alias("_new"))
            out = out.join(new, "r", "left").select("r", F.coalesce("_new", "values").alias("values"))
        done = done.unionByName(out.select(F.lit(name).alias("name"), "r", "values"))
    return T.rename(done, LANGUAGE, "model.", drop=OTHERS) if text_only else done


def upcycle_model(tensors: DataFrame, layers: list[str], width: int, hidden: int, experts: int, copy: bool = True) -> DataFrame:
    """A dense model's tensors as (name, e, r, values) of one of experts: each listed layer's gate, up and
    down matrices become its experts', with a router; all others stay, as expert 0."""
    dense = [f"{layer}.mlp.{x}_proj.weight" for layer in layers for x in ("gate", "up", "down")]
    done = tensors.filter(~F.col("name").isin(dense)).select("name", F.lit(0).alias("e"), "r", "values")
    for layer in layers:
        done = done.unionByName(T.dense_to_experts(tensors, layer, width, hidden, experts, copy))
    return done
