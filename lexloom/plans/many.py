"""The rewrite of many tokenizers in one run: plans as tables, keyed by tokenizer.

What `sanitize` does for one tokenizer, for any number at once: all steps are joins on
(tokenizer_id, token), windows over a tokenizer, or kernels on a tokenizer's group (orders, synthesis), so
tokenizers spread over tasks and nothing comes to the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import merges as M
from ..operators import rewrite as R
from ..session import settled

#: What a row of a plan may ask for.
ACTIONS = ("delete", "add", "rename", "keep_special", "rename_special")
#: tokenizer_id, action, seq (order of additions), token, new_token (of renames).
PLAN = "tokenizer_id string, action string, seq int, token string, new_token string"
_TOKEN = ["tokenizer_id", "token"]


@dataclass
class Rewritten:
    """Tables of the new tokenizers, each keyed by tokenizer_id."""

    rules: DataFrame  # place, left, right, merged
    deleted_rules: DataFrame  # the same of the rules that went
    remap: DataFrame  # token, old_id, new_id, class (0 special, 1 unmerged, 2 merged)
    gone: DataFrame  # token
    added: DataFrame  # seq, token, left, right, parts: tokens that were there, of which an added token is made
    requested: DataFrame  # seq, token, ignored (it was there)
    specials: DataFrame  # token, old_token

    @property
    def vocab(self) -> DataFrame:
        """tokenizer_id, token, id."""
        return self.remap.select(*_TOKEN, F.col("new_id").alias("id"))


def asked(plan: DataFrame, action: str) -> DataFrame:
    return plan.filter(F.col("action") == action).drop("action")


def special_plan(specials: DataFrame, plan: DataFrame) -> DataFrame:
    """specials (tokenizer_id, token) with new_token: its name afterwards, null if it is dropped. A tokenizer whose plan
    names no special token keeps all."""
    named = plan.filter(F.col("action").isin("keep_special", "rename_special")).select(*_TOKEN, F.coalesce("new_token", "token").alias("new_token"))
    edited = named.select("tokenizer_id").distinct().withColumn("_edited", F.lit(True))
    out = specials.select(*_TOKEN).join(named, _TOKEN, "left").join(edited, "tokenizer_id", "left")
    return out.select(*_TOKEN, F.when(F.col("_edited"), F.col("new_token")).otherwise(F.col("token")).alias("new_token"))


def plan_conflicts(vocab: DataFrame, specials: DataFrame, plan: DataFrame) -> DataFrame:
    """(tokenizer_id, problem, token): what a plan asks for that contradicts itself or the vocabulary. Empty if it is sound."""
    kept = special_plan(specials, plan)
    after = kept.filter("new_token is not null").select("tokenizer_id", F.col("new_token").alias("token"))
    moved = kept.filter("new_token <> token")
    base = R.rewrite_vocab(vocab, kept.filter("new_token is null").select(*_TOKEN), moved, vocab.limit(0).select("tokenizer_id", F.lit(0).alias("seq"), "token"))
    lists = {a: asked(plan, a).select(*_TOKEN) for a in ACTIONS}
    lists["special"] = after
    lists["rename target"] = asked(plan, "rename").select("tokenizer_id", F.col("new_token").alias("token"))
    targets = moved.select("tokenizer_id", F.col("new_token").alias("token"))
    tell = lambda rows, problem: rows.select("tokenizer_id", F.lit(problem).alias("problem"), "token")
    out = [tell(plan.filter(~F.col("action").isin(*ACTIONS) | F.col("token").isNull()), "no such action, or no token")]
    for name in ("delete", "add", "rename", "keep_special", "rename_special", "rename target"):
        out.append(tell(lists[name].groupBy(*_TOKEN).count().filter("count > 1"), f"{name}: repeated"))
    out.append(tell(targets.groupBy(*_TOKEN).count().filter("count > 1"), "two special tokens get the same name"))
    pairs = [("delete", "add"), ("delete", "rename"), ("add", "rename"), ("delete", "special"), ("add", "special"), ("rename", "special"), ("rename target", "special"), ("rename target", "add"), ("keep_special", "rename_special")]
    for a, b in pairs:
        out.append(tell(lists[a].join(lists[b].distinct(), _TOKEN, "left_semi"), f"in both {a} and {b}"))
    for name in ("delete", "rename"):
        out.append(tell(lists[name].join(base, _TOKEN, "left_anti"), f"{name}: not in the vocabulary"))
    named = lists["keep_special"].unionByName(lists["rename_special"])
    out.append(tell(named.join(specials.select(*_TOKEN), _TOKEN, "left_anti"), "not special"))
    free = lists["rename"].unionByName(lists["delete"])
    out.append(tell(lists["rename target"].join(base, _TOKEN, "left_semi").join(free, _TOKEN, "left_anti"), "rename target exists"))
    free = kept.filter("new_token is null or new_token <> token").select(*_TOKEN)
    out.append(tell(targets.join(vocab, _TOKEN, "left_semi").join(free, _TOKEN, "left_anti"), "special name is taken"))
    return reduce(DataFrame.unionByName, out).distinct()


def named_anew(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Columns of tokens under new names (tokenizer_id, token, new_token), others as they are."""
    for c in columns:
        to = names.select("tokenizer_id", F.col("token").alias(c), F.col("new_token").alias("_new"))
        rows = rows.join(to, ["tokenizer_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def substrings(token: Column) -> Column:
    """All different parts of a token, itself included."""
    n = F.length(token)
    cut = lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(token, i, k))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), cut))))


def synthesized(additions: DataFrame, tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """What the additions (tokenizer_id, seq, token) need beyond the tokens and rules at hand: rows of kind `token` (an
    added token, with left, right and the tokens at hand that it is made of: parts), `rule` (a pair that has none
    yet) and `request` (an addition; ignored if it was there), numbered by n. Each addition may use what the ones
    before it have made. Only tokens and rules that lie within an addition of the same tokenizer enter a group."""
    inside = additions.select("tokenizer_id", F.explode(substrings(F.col("token"))).alias("token")).distinct()
    there = tokens.join(inside, _TOKEN, "left_semi").select(*_TOKEN, F.lit(None).cast("string").alias("left"))
    pairs = rules.select("tokenizer_id", F.concat("left", "right").alias("token"), "left").join(inside, _TOKEN, "left_semi")

    def one(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known = set(held.token[held.left.isna()])
        made = {(r.left, r.token[len(r.left) :]) for r in held[held.left.notna()].itertuples()}
        parts = {t: [t] for t in known}
        out: list[tuple] = []
        for seq, token in sorted(zip(wanted.seq, wanted.token, strict=True)):
            out.append(("request", token, None, None, None, token in known))
            for left, right in M.synthesize(token, known):
                if left + right not in known:
                    known.add(left + right)
                    parts[left + right] = parts[left] + parts[right]
                    out.append(("token", left + right, left, right, parts[left + right], False))
                if (left, right) not in made:
                    made.add((left, right))
                    out.append(("rule", left + right, left, right, None, False))
        rows = pd.DataFrame(out, columns=["kind", "token", "left", "right", "parts", "ignored"])
        rows["n"], rows["tokenizer_id"] = range(len(rows)), key[0]
        return rows

    schema = "kind string, token string, left string, right string, parts array<string>, ignored boolean, n int, tokenizer_id string"
    wanted = additions.select(F.col("tokenizer_id").alias("_tokenizer"), F.col("seq").alias("seq"), F.col("token").alias("token"))
    return wanted.groupBy("_tokenizer").cogroup(there.unionByName(pairs).groupBy("tokenizer_id")).applyInPandas(one, schema)


def sanitize_many(vocab: DataFrame, rules: DataFrame, specials: DataFrame, plan: DataFrame, order: str = "good", seed: int | None = None, check: bool = True) -> Rewritten:
    """Applies to each tokenizer its rows of the plan (PLAN), as `sanitize` applies edits to one.

    vocab: tokenizer_id, token, id; rules: tokenizer_id, idx, left, right, merged; specials: tokenizer_id, token.
    Tokenizers without a row are put in order and numbered anew only. check: PlanError if `plan_conflicts` finds
    something. What several of the new tables rest on (deletions, ordered rules, additions, new ids) is worked out
    once and kept in the shared folder."""
    if check and (odd := plan_conflicts(vocab, specials, plan).take(8)):
        raise R.PlanError("; ".join(f"{r.tokenizer_id}: {r.problem}: {r.token!r}" for r in odd))
    kept = special_plan(specials, plan)
    marked = kept.filter("new_token is not null").select("tokenizer_id", F.col("new_token").alias("token"), F.col("token").alias("old_token"))
    moved = kept.filter("new_token <> token")
    nothing = vocab.limit(0).select("tokenizer_id", F.lit(0).alias("seq"), "token")
    base = R.rewrite_vocab(vocab, kept.filter("new_token is null").select(*_TOKEN), moved, nothing)
    own = named_anew(rules, moved, "left", "right", "merged")
    gone = settled(M.delete_cascade(own, asked(plan, "delete")))
    names = asked(plan, "rename").select(*_TOKEN, "new_token")
    placed = own.join(M.ordered(own, M.edges(own), order, seed), ["tokenizer_id", "idx"]).select("tokenizer_id", "place", "left", "right", "merged")
    placed = settled(named_anew(placed, names, "left", "right", "merged"))

    made = settled(synthesized(asked(plan, "add").select("tokenizer_id", "seq", "token"), R.rewrite_vocab(base, gone, names, nothing), placed))
    by_n = Window.partitionBy("tokenizer_id").orderBy("n")
    added = made.filter("kind = 'token'").select("tokenizer_id", (F.row_number().over(by_n) - 1).alias("seq"), "token", "left", "right", "parts")
    new_vocab = settled(R.rewrite_vocab(base, gone, names, added.select("tokenizer_id", "seq", "token")))
    live = placed
    for side in ("left", "right", "merged"):
        live = live.join(new_vocab.select("tokenizer_id", F.col("token").alias(side)), ["tokenizer_id", side], "left_semi")
    first = made.filter("kind = 'rule'")
    whole = F.count(F.lit(1)).over(Window.partitionBy("tokenizer_id"))
    first = first.select("tokenizer_id", (F.row_number().over(by_n) - 1 - whole).cast("int").alias("place"), "left", "right", F.col("token").alias("merged"))
    new_rules = settled(first.unionByName(live.select(*first.columns)))
    remap = settled(R.reassign_ids(new_vocab, new_rules, marked))
    dropped = placed.join(live.select("tokenizer_id", "place"), ["tokenizer_id", "place"], "left_anti").select(*first.columns)
    requested = made.filter("kind = 'request'").select("tokenizer_id", (F.row_number().over(by_n) - 1).alias("seq"), "token", "ignored")
    return Rewritten(new_rules, dropped, remap, gone, added, requested, marked)


def initializer_table(done: Rewritten) -> DataFrame:
    """(tokenizer_id, new_id, token, old_ids): of which old tokens' rows each added token's row is the mean."""
    parts = done.added.select("tokenizer_id", "token", F.posexplode("parts").alias("i", "part"))
    ids = done.remap.select("tokenizer_id", F.col("token").alias("part"), F.col("old_id"))
    known = parts.join(ids, ["tokenizer_id", "part"]).groupBy(*_TOKEN).agg(F.array_sort(F.collect_list(F.struct("i", "old_id"))).alias("_p"))
    return known.join(done.remap.select(*_TOKEN, "new_id"), _TOKEN).select("tokenizer_id", "new_id", "token", F.transform("_p", lambda x: x["old_id"]).alias("old_ids"))


def group_table(done: Rewritten) -> DataFrame:
    """(tokenizer_id, and lists of new ids: original_ids, added_ids, requested_ids, intermediate_ids, special_ids) of
    each tokenizer, special ones in the order of their old ids."""
    mark = lambda rows, name: rows.select(*_TOKEN).distinct().withColumn(name, F.lit(True))
    rows = done.remap.join(mark(done.added, "_added"), _TOKEN, "left").join(mark(done.requested.filter("not ignored"), "_requested"), _TOKEN, "left")
    ids = lambda c, name: F.array_sort(F.collect_list(F.when(c, F.col("new_id")))).alias(name)
    added, wanted = F.coalesce("_added", F.lit(False)), F.coalesce("_requested", F.lit(False))
    special = F.array_sort(F.collect_list(F.when(F.col("class") == 0, F.struct("old_id", "new_id"))))
    return rows.groupBy("tokenizer_id").agg(
        ids(~added, "original_ids"), ids(added, "added_ids"), ids(added & wanted, "requested_ids"), ids(added & ~wanted, "intermediate_ids"),
        F.transform(special, lambda x: x["new_id"]).alias("special_ids"),
    )


def file_bodies(done: Rewritten) -> DataFrame:
    """(tokenizer_id, name, body): the rules, the vocabulary, the id mapping, the initializers and the token groups of
    each tokenizer as the texts of its files, all of one vocabulary's size."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "left", "right").alias("t")))), lambda x: x["t"])
    rules = done.rules.groupBy("tokenizer_id").agg(F.concat(F.lit("#version: 0.2\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("body"))
    entry = lambda k, v: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k[0]).alias("o"), k[1].alias("k"), F.col(v).alias("v")))), lambda x: F.struct(x["k"], x["v"])))
    vocab = done.remap.groupBy("tokenizer_id").agg(F.to_json(entry(("new_id", F.col("token")), "new_id")).alias("body"))
    kept = done.remap.join(done.added.select(*_TOKEN), _TOKEN, "left_anti")
    mapping = kept.groupBy("tokenizer_id").agg(F.to_json(entry(("old_id", F.col("old_id").cast("string")), "new_id")).alias("body"))
    starts = initializer_table(done).groupBy("tokenizer_id").agg(F.to_json(entry(("new_id", F.col("new_id").cast("string")), "old_ids")).alias("body"))
    groups = group_table(done)
    groups = groups.select("tokenizer_id", F.to_json(F.struct(*[c for c in groups.columns if c != "tokenizer_id"])).alias("body"))
    named = {"merges.txt": rules, "vocab.json": vocab, "id_mapping.json": mapping, "initializers.json": starts, "token_groups.json": groups}
    return reduce(DataFrame.unionByName, [rows.select("tokenizer_id", F.lit(name).alias("name"), "body") for name, rows in named.items()])


def counts(done: Rewritten, vocab: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a tokenizer: tokens and rules before and after, tokens gone, added, asked for and ignored, rules made and gone."""
    n = lambda rows, name: rows.groupBy("tokenizer_id").agg(F.count(F.lit(1)).alias(name))
    out = n(vocab, "tokens_before")
    more = [
        n(done.remap, "tokens_after"), n(rules, "rules_before"), n(done.rules, "rules_after"), n(done.gone, "tokens_deleted"), n(done.added, "tokens_added"),
        n(done.requested, "tokens_requested"), n(done.requested.filter("ignored"), "requests_ignored"), n(done.rules.filter("place < 0"), "rules_made"), n(done.deleted_rules, "rules_deleted"),
    ]
    for part in more:
        out = out.join(part, "tokenizer_id", "left")
    return out.fillna(0)
