"""Vocabulary rewriting: plans as tables, applied with joins; JSON configs by a pure function."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The text model's type and architecture, and the keys of other modalities. Fixed values.
TEXT_ARCHITECTURE, TEXT_MODEL_TYPE = "Gemma4ForCausalLM", "gemma4_text"
MODALITY_KEYS = ("audio_token", "image_token", "video_token", "processor_class")


class PlanError(ValueError):
    """Lists of tokens that contradict each other or the vocabulary."""


def _held(vocab: DataFrame, tokens: set[str]) -> set[str]:
    """Those of a list of tokens that a vocabulary has."""
    asked = vocab.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    return {r[0] for r in vocab.select("token").join(asked, "token", "left_semi").distinct().collect()} if tokens else set()


def check_plan(vocab: DataFrame, delete: list[str], add: list[str], rename: dict[str, str], special: list[str]) -> None:
    """Raises PlanError for repeated or unknown tokens, for tokens in two lists, for special tokens, and
    for rename targets that are taken: by another rename, a special token, an addition, or a token that
    is neither renamed nor deleted itself."""
    for name, items in (("delete", delete), ("add", add), ("rename targets", list(rename.values()))):
        if len(set(items)) < len(items):
            raise PlanError(f"{name}: tokens repeat")
    targets = set(rename.values())
    sets = {"delete": set(delete), "add": set(add), "rename": set(rename), "special": set(special), "rename targets": targets}
    pairs = [("delete", "add"), ("delete", "rename"), ("add", "rename"), ("delete", "special"), ("add", "special"), ("rename", "special"), ("rename targets", "special"), ("rename targets", "add")]
    for a, b in pairs:
        if both := sets[a] & sets[b]:
            raise PlanError(f"in both {a} and {b}: {sorted(both)[:8]}")
    asked = sets["delete"] | sets["rename"]
    there = _held(vocab, asked | targets)
    if missing := sorted(asked - there):
        raise PlanError(f"not in the vocabulary: {missing[:8]}")
    if clash := (targets & there) - sets["rename"] - sets["delete"]:
        raise PlanError(f"rename targets exist: {sorted(clash)[:8]}")


def check_special_plan(vocab: DataFrame, specials: list[str], keep: list[str], rename: dict[str, str]) -> list[str]:
    """The special tokens that go: those neither kept nor renamed. PlanError for literals that are not
    special, for one that is both kept and renamed, and for targets that two share or that are taken: by a
    token that stays (a target may be dropped or renamed itself)."""
    if both := set(keep) & set(rename):
        raise PlanError(f"both kept and renamed: {sorted(both)}")
    if odd := (set(keep) | set(rename)) - set(specials):
        raise PlanError(f"not special: {sorted(odd)[:8]}")
    moved = {k: v for k, v in rename.items() if k != v}
    if len(set(moved.values())) < len(moved):
        raise PlanError("two special tokens get the same name")
    dropped = [s for s in specials if s not in keep and s not in rename]
    if clash := _held(vocab, set(moved.values())) - set(dropped) - set(moved):
        raise PlanError(f"special names are taken: {sorted(clash)[:8]}")
    return dropped


def rewrite_vocab(vocab: DataFrame, gone: DataFrame, renames: DataFrame, added: DataFrame) -> DataFrame:
    """vocab (tokenizer_id, token, id) without the tokens of `gone` (tokenizer_id, token), with those
    of `renames` (token, new_token, and tokenizer_id if they differ) renamed and those of `added` (tokenizer_id, seq, token) appended
    from the largest id on."""
    on = [c for c in ("tokenizer_id", "token") if c in renames.columns]
    kept = vocab.join(gone, ["tokenizer_id", "token"], "left_anti").join(renames, on, "left")
    kept = kept.select("tokenizer_id", F.coalesce("new_token", "token").alias("token"), "id")
    top = vocab.groupBy("tokenizer_id").agg(F.max("id").alias("_top"))
    number = F.row_number().over(Window.partitionBy("tokenizer_id").orderBy("seq"))
    return kept.unionByName(added.join(top, "tokenizer_id").select("tokenizer_id", "token", (F.col("_top") + number).alias("id")))


def special_actions(specials: DataFrame, keep: list[str], rename: dict[str, str]) -> DataFrame:
    """(literal, action, new_literal) of each special token: keep, rename, or drop if not listed."""
    if both := set(keep) & set(rename):
        raise PlanError(f"both kept and renamed: {sorted(both)}")
    spark = specials.sparkSession
    plan = spark.createDataFrame([(k, k, "keep") for k in keep] + [(k, v, "rename") for k, v in rename.items()], "literal string, new_literal string, action string")
    return specials.select("literal").distinct().join(plan, "literal", "left").select("literal", F.coalesce("action", F.lit("drop")).alias("action"), "new_literal")


def reassign_ids(vocab: DataFrame, ordered_rules: DataFrame, specials: DataFrame) -> DataFrame:
    """(tokenizer_id, token, old_id, new_id, class): new numbers from 0: special tokens by old id,
    then other unmerged tokens by text, then merged tokens in the order of the first rule that makes
    them. ordered_rules: tokenizer_id, place, merged; specials: tokenizer_id, token."""
    first = ordered_rules.groupBy("tokenizer_id", F.col("merged").alias("token")).agg(F.min("place").alias("_place"))
    marked = specials.select("tokenizer_id", "token").distinct().withColumn("_special", F.lit(True))
    rows = vocab.join(first, ["tokenizer_id", "token"], "left").join(marked, ["tokenizer_id", "token"], "left")
    kind = F.when(F.col("_special"), 0).when(F.col("_place").isNull(), 1).otherwise(2)
    # a special token that a rule makes would be of two classes
    sure = F.assert_true(~(F.coalesce("_special", F.lit(False)) & F.col("_place").isNotNull()), F.lit("a special token is made by a rule"))
    rows = rows.withColumn("class", kind).filter(sure.isNull())
    key = [F.col("class"), F.when(F.col("class") == 0, F.col("id")), F.when(F.col("class") == 1, F.col("token")), F.col("_place"), F.col("id")]
    number = (F.row_number().over(Window.partitionBy("tokenizer_id").orderBy(*key)) - 1).cast("long")
    return rows.select("tokenizer_id", "token", F.col("id").alias("old_id"), number.alias("new_id"), "class")


def rule_ids(rules: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rules with the ids of their three tokens. A token without an id is an error when read."""
    out = rules
    for side in ("merged", "left", "right"):
        named = vocab.select("tokenizer_id", F.col("token").alias(side), F.col("id").alias(f"{side}_id"))
        out = out.join(named, ["tokenizer_id", side], "left")
    good = F.assert_true(F.col("merged_id").isNotNull() & F.col("left_id").isNotNull() & F.col("right_id").isNotNull(), F.lit("a rule's token is not in the vocabulary"))
    return out.filter(good.isNull()).select("tokenizer_id", "idx", "merged_id", "left_id", "right_id")


def token_groups(remap: DataFrame, added: list[str], requested: list[str], special: list[str]) -> DataFrame:
    """Per tokenizer: ids, in the new numbering, of original, added, requested, intermediate and
    special tokens."""
    inside = lambda xs: F.col("token").isin(xs) if xs else F.lit(False)
    pick = lambda cond, name: F.array_sort(F.collect_list(F.when(cond, F.col("new_id")))).alias(name)
    place = F.create_map(*[x for i, t in enumerate(special) for x in (F.lit(t), F.lit(i))]) if special else None
    in_order = F.collect_list(F.when(inside(special), F.struct(place[F.col("token")].alias("i"), F.col("new_id").alias("id")))) if special else None
    specials = F.transform(F.array_sort(in_order), lambda s: s["id"]) if special else F.array().cast("array<bigint>")
    return remap.groupBy("tokenizer_id").agg(
        pick(~inside(added), "original_ids"), pick(inside(added), "added_ids"), pick(inside(requested), "requested_ids"),
        pick(inside(added) & ~inside(requested), "intermediate_ids"), specials.alias("special_ids"),
    )


def initializers(added: dict[str, tuple[str, str]], remap: dict[str, tuple[int | None, int]]) -> dict[int, list[int]]:
    """For each added token (in order; token to its two parts), the old ids of the tokens that it is
    made of, by its new id. remap: token to (old id, new id)."""

    def flat(token: str) -> list[int]:
        if token in added:
            left, right = added[token]
            return flat(left) + flat(right)
        old = remap[token][0]
        if old is None:
            raise PlanError(f"{token!r} has no old id")
        return [old]

    return {remap[token][1]: flat(token) for token in added}


_DROP = object()


@dataclass(frozen=True)
class ConfigPlan:
    """How ids and literals in the files beside a tokenizer change: old to new ids, new names of literals,
    literals and ids that are gone, and the new size of the vocabulary (None: sizes stay)."""

    mapping: dict[int, int]
    literals: dict[str, str]
    dropped: frozenset[str] = frozenset()
    dropped_ids: frozenset[int] = frozenset()
    size: int | None = None

    def ident(self, x: Any) -> Any:
        """The new id; a gone id drops, one that nothing maps is an error."""
        if isinstance(x, bool) or not isinstance(x, int):
            return x
        if x in self.dropped_ids:
            return _DROP
        if x not in self.mapping:
            raise PlanError(f"id {x} is not in the vocabulary")
        return self.mapping[x]

    def idents(self, x: Any) -> Any:
        if not isinstance(x, list):
            return self.ident(x)
        kept = [y for y in map(self.ident, x) if y is not _DROP]
        return kept if kept or not x else _DROP

    def literal(self, x: Any) -> Any:
        """A literal, or an object with one at `content`, under its new name."""
        if isinstance(x, dict) and isinstance(x.get("content"), str):
            to = self.literal(x["content"])
            return _DROP if to is _DROP else x | {"content": to}
        if not isinstance(x, str):
            return x
        return _DROP if x in self.dropped else self.literals.get(x, x)

    def many(self, x: Any) -> Any:
        """Literals in a list or as values of an object; what is then empty goes."""
        if isinstance(x, list):
            return [y for y in map(self.literal, x) if y is not _DROP] or _DROP
        if isinstance(x, dict):
            return {k: y for k, y in ((k, self.literal(v)) for k, v in x.items()) if y is not _DROP} or _DROP
        return x

    def decoder(self, x: dict[str, Any]) -> Any:
        """An object from ids to descriptions, in the order of the new ids; keys that are no ids go."""
        kept = []
        for k, v in x.items():
            v = self.literal(v)
            new = self.ident(int(k)) if k.isdigit() and v is not _DROP else _DROP
            if new is not _DROP:
                kept.append((new, v | {"id": new} if isinstance(v, dict) and "id" in v else v))
        return {str(k): v for k, v in sorted(kept, key=lambda p: p[0])} or _DROP

    def encoder(self, x: dict[str, Any]) -> Any:
        """An object from literals to ids, in the order of the new ids."""
        kept = [(self.literal(k), self.ident(v)) for k, v in x.items() if k not in self.dropped]
        kept = [(k, v) for k, v in kept if v is not _DROP]
        return dict(sorted(kept, key=lambda p: p[1] if isinstance(p[1], int) else 1 << 30)) or _DROP

    def config(self, x: Any) -> Any:
        """A config at any depth: `*_token_id`, `*_token`, `content`, `tokens`, extra_special_tokens, the
        decoder and encoder of added tokens, the sizes of the vocabulary. Other strings stay."""
        if isinstance(x, list):
            return [y for y in map(self.config, x) if y is not _DROP]
        if not isinstance(x, dict):
            return x
        out = {}
        for k, v in x.items():
            if k == "content" and isinstance(v, str):
                v = self.literal(v)
                if v is _DROP:
                    return _DROP
            elif k == "tokens" and isinstance(v, list):
                v = [y for y in map(self.literal, v) if y is not _DROP]
            elif k == "added_tokens_decoder" and isinstance(v, dict):
                v = self.decoder(v)
            elif k == "added_tokens_encoder" and isinstance(v, dict):
                v = self.encoder(v)
            elif k in ("vocab_size", "vocab_size_per_layer_input") and isinstance(v, int) and self.size is not None:
                v = self.size
            elif k.endswith("_token_id"):
                v = self.idents(v)
            elif k.endswith("_token"):
                v = self.literal(v)
            elif k == "extra_special_tokens":
                v = self.many(v)
            else:
                v = self.config(v)
            if v is not _DROP:
                out[k] = v
        return out

    def added_tokens(self, x: list[Any]) -> list[Any]:
        """The list of added tokens, by new id, then content; entries without an id come last."""
        kept = []
        for t in x:
            if isinstance(t, dict):
                t = self.literal(t)
                new = _DROP if t is _DROP else self.ident(t.get("id"))
                if new is _DROP:
                    continue
                t = t | {"id": new} if "id" in t else t
            kept.append(t)
        place = lambda t: (t["id"] if isinstance(t, dict) and isinstance(t.get("id"), int) else 1 << 30, t.get("content") or "" if isinstance(t, dict) else "")
        return sorted(kept, key=place)

    def post_processor(self, x: Any, parent: str | None = None) -> Any:
        """A post-processor: names and contents of special tokens, and below its `special_tokens` the ids."""
        if isinstance(x, list):
            return [y for y in (self.post_processor(v, parent) for v in x) if y is not _DROP]
        if isinstance(x, str):
            return self.literal(x) if parent in ("content", "token", "tokens") else x
        if not isinstance(x, dict):
            return x
        out = {}
        for k, v in x.items():
            name = self.literal(k) if parent == "special_tokens" else k
            if name is _DROP:
                continue
            inside = parent == "special_tokens" and isinstance(v, dict)
            done = {i: self.idents(w) if i in ("id", "ids") else self.post_processor(w, i) for i, w in v.items()} if inside else self.post_processor(v, k)
            if done is not _DROP:
                out[name] = done
        return out


def remap_config(body: str, plan: ConfigPlan) -> str:
    """A config's JSON under a plan."""
    done = plan.config(json.loads(body))
    return json.dumps({} if done is _DROP else done, ensure_ascii=False)


def text_only_config(body: str) -> str:
    """A multimodal model's config as that of its text model: what is at `text_config`, with the text
    model's type and architecture and the path of the whole."""
    held = json.loads(body)
    inner = held.get("text_config")
    if not isinstance(inner, dict):
        raise PlanError("the config has no text_config")
    out = inner | {"architectures": [TEXT_ARCHITECTURE], "model_type": TEXT_MODEL_TYPE}
    if "_name_or_path" in held:
        out.setdefault("_name_or_path", held["_name_or_path"])
    return json.dumps(out, ensure_ascii=False)


def text_only_tokenizer_config(body: str) -> str:
    """A tokenizer's config without the tokens and the processor of other modalities."""
    return json.dumps({k: v for k, v in json.loads(body).items() if k not in MODALITY_KEYS}, ensure_ascii=False)


def expert_config(body: str, experts: int, top_k: int) -> str:
    """A dense text model's config (or that at `text_config`) as one of experts: as many experts as asked,
    each as wide as the dense layer, which is twice as wide where layers share their keys and values
    and the wide form is in use; keys of the dense form go."""
    held = json.loads(body)
    config = dict(held["text_config"]) if isinstance(held.get("text_config"), dict) else held
    width = int(config["intermediate_size"])
    if config.get("use_double_wide_mlp") and int(config.get("num_kv_shared_layers") or 0) > 0:
        width *= 2
    if not 1 <= top_k <= experts:
        raise PlanError(f"{top_k} of {experts} experts")
    config.pop("use_double_wide_mlp", None)
    return json.dumps(config | {"enable_moe_block": True, "num_experts": experts, "top_k_experts": top_k, "moe_intermediate_size": width}, ensure_ascii=False)


def small_config(body: str, layers: int, hidden: int, heads: int, width: int) -> str:
    """A small model's config of the same kind: sizes replaced, a list with one entry a layer cut to the
    layers left. Sizes must divide."""
    if min(layers, hidden, heads, width) < 1 or hidden % heads:
        raise PlanError(f"a hidden size of {hidden} has no {heads} heads")
    config = json.loads(body)
    old = config.get("num_hidden_layers")
    out = {k: v[:layers] if isinstance(v, list) and old is not None and len(v) == old else v for k, v in config.items()}
    kv = max(k for k in range(1, min(heads, int(config.get("num_key_value_heads") or heads)) + 1) if heads % k == 0)
    return json.dumps(out | {"num_hidden_layers": layers, "hidden_size": hidden, "num_attention_heads": heads, "num_key_value_heads": kv, "head_dim": hidden // heads, "intermediate_size": width}, ensure_ascii=False)


def rewritten(configs: DataFrame, change: Callable[[str], str], body: str = "body") -> DataFrame:
    """Config documents under a function of their text, in Arrow batches; null stays null."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else change(x))

    return configs.withColumn(body, F.pandas_udf(batch, T.StringType())(F.col(body)))


def remap_configs(configs: DataFrame, plan: ConfigPlan, body: str = "body") -> DataFrame:
    """Config documents rewritten by `remap_config`; the plan is one vocabulary's."""
    return rewritten(configs, lambda x: remap_config(x, plan), body)


def mapping_json(remap: DataFrame, added: Column) -> DataFrame:
    """(tokenizer_id, body): old to new ids as one JSON object, keys by number, added tokens left out."""
    pairs = F.array_sort(F.collect_list(F.when(~added, F.struct(F.col("old_id").alias("k"), F.col("new_id").alias("v")))))
    named = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].cast("string"), p["v"])))
    return remap.groupBy("tokenizer_id").agg(F.to_json(named).alias("body"))
