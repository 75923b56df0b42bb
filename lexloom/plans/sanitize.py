"""The whole rewrite of a tokenizer: special tokens, deletions, renames, additions, order, ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merges as M
from ..operators import rewrite as R


@dataclass
class Edits:
    """What to change; keep_special=None with no rename_special keeps all special tokens as they are."""

    delete: list[str] = field(default_factory=list)
    add: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    keep_special: list[str] | None = None
    rename_special: dict[str, str] = field(default_factory=dict)
    order: str = "good"
    seed: int | None = None

    @property
    def special(self) -> bool:
        return self.keep_special is not None or bool(self.rename_special)

    @property
    def tokens(self) -> bool:
        return bool(self.delete or self.add or self.rename)


@dataclass
class Sanitized:
    """Tables of the new tokenizer, and what was done. Lists are as long as the lists of edits (and
    what these make) at most."""

    rules: DataFrame  # tokenizer_id, place, left, right, merged
    deleted_rules: DataFrame  # the same of the rules that went
    vocab: DataFrame  # tokenizer_id, token, id (new)
    remap: DataFrame  # tokenizer_id, token, old_id, new_id, class
    gone: DataFrame  # tokenizer_id, token: deleted, with all that was made of these
    added: dict[str, tuple[str, str]]  # added tokens in order, with the pair that makes each
    made: list[tuple[str, str]]  # pairs that stand before all others
    requested: list[str]
    ignored: list[str]
    specials: list[str]  # their new names, in order
    kept_special: dict[str, str]
    dropped_special: list[str]
    initializers: dict[int, list[int]]
    edits: Edits


def sanitize(vocab: DataFrame, rules: DataFrame, specials: list[str], edits: Edits) -> Sanitized:
    """Applies the edits to one tokenizer (vocab: tokenizer_id, token, id; rules with idx; specials by id).

    Special tokens come first, then deletions (with all tokens made of them), renames, additions built
    from what is then there; rules stay whose three tokens are in the new vocabulary. All steps are joins on
    plan tables. To the driver come only tokens and rules that lie within an added token."""
    spark = vocab.sparkSession
    tid = vocab.select("tokenizer_id").first()[0]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    dropped = R.check_special_plan(vocab, specials, edits.keep_special or [], edits.rename_special) if edits.special else []
    kept_special = {s: edits.rename_special.get(s, s) for s in specials if s not in dropped}
    moved = table([(k, v) for k, v in kept_special.items() if k != v], "token string, new_token string")
    none = table([], "tokenizer_id string, seq int, token string")
    base = R.rewrite_vocab(vocab, table([(tid, t) for t in dropped], "tokenizer_id string, token string"), moved, none)
    for side in ("left", "right", "merged"):
        rules = _renamed(rules, moved, side)
    R.check_plan(base, edits.delete, edits.add, edits.rename, list(kept_special.values()))

    gone = M.delete_cascade(rules, table([(tid, t) for t in edits.delete], "tokenizer_id string, token string"))
    names = table(list(edits.rename.items()), "token string, new_token string")
    order = M.ordered(rules, M.edges(rules), edits.order, edits.seed)
    placed = rules.join(order, ["tokenizer_id", "idx"]).select("tokenizer_id", "place", "left", "right", "merged")
    for side in ("left", "right", "merged"):
        placed = _renamed(placed, names, side)

    # additions see renamed tokens and pairs
    inside = table([(t,) for t in sorted({x[i:j] for x in edits.add for i in range(len(x)) for j in range(i + 1, len(x) + 1)})], "token string")
    there = R.rewrite_vocab(base, gone, names, none).join(inside, "token", "left_semi")
    tokens = {r[0] for r in there.select("token").collect()} if edits.add else set()
    held = placed.withColumn("token", F.concat("left", "right")).join(inside, "token", "left_semi")
    pairs = {(r[0], r[1]) for r in held.select("left", "right").collect()} if edits.add else set()
    added: dict[str, tuple[str, str]] = {}
    made: list[tuple[str, str]] = []
    requested, ignored = [], []
    for t in edits.add:  # each addition may use what the ones before it have made
        if t in tokens:
            ignored.append(t)
            continue
        for left, right in M.synthesize(t, tokens):
            if left + right not in tokens:
                added[left + right] = (left, right)
                tokens.add(left + right)
            if (left, right) not in pairs:
                pairs.add((left, right))
                made.append((left, right))
        requested.append(t)
    new_vocab = R.rewrite_vocab(base, gone, names, table([(tid, i, t) for i, t in enumerate(added)], "tokenizer_id string, seq int, token string"))

    live = placed
    for side in ("left", "right", "merged"):
        live = live.join(new_vocab.select("tokenizer_id", F.col("token").alias(side)), ["tokenizer_id", side], "left_semi")
    live = live.select(*placed.columns)
    first = table([(tid, i - len(made), l, r, l + r) for i, (l, r) in enumerate(made)], "tokenizer_id string, place int, left string, right string, merged string")
    new_rules = first.unionByName(live)
    marked = table([(tid, s) for s in kept_special.values()], "tokenizer_id string, token string")
    remap = R.reassign_ids(new_vocab, new_rules, marked)
    known = {}
    if added:
        asked = table([(t,) for t in sorted({p for t in added for p in (t, *added[t])})], "token string")
        known = {r.token: (None if r.token in added else r.old_id, r.new_id) for r in remap.join(asked, "token", "left_semi").collect()}
    return Sanitized(
        new_rules, placed.join(live.select("tokenizer_id", "place"), ["tokenizer_id", "place"], "left_anti").select(*placed.columns),
        remap.select("tokenizer_id", "token", F.col("new_id").alias("id")), remap, gone, added, made, requested, ignored,
        list(kept_special.values()), kept_special, dropped, R.initializers(added, known), edits,
    )


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """A column under the new names (token, new_token), others as they are."""
    to = names.select(F.col("token").alias(column), F.col("new_token").alias("_new"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def summary(done: Sanitized, before: DataFrame, rules_before: DataFrame) -> DataFrame:
    """One row: how many special tokens were kept, renamed and dropped, tokens deleted, renamed, added,
    ignored, rules made and deleted, and their lists (pairs as `left right`); tokens and rules before and
    after."""
    e, spark = done.edits, before.sparkSession
    renamed = {k: v for k, v in done.kept_special.items() if k != v} if e.special else {}
    between = [t for t in done.added if t not in done.requested]
    special = e.special
    counts = {
        "special_tokens_kept": len(done.kept_special) if special else 0, "special_tokens_renamed": len(renamed), "special_tokens_dropped": len(done.dropped_special),
        "requested_tokens_deleted": len(e.delete), "requested_tokens_renamed": len(e.rename), "requested_tokens_added": len(e.add),
        "existing_tokens_ignored": len(done.ignored), "requested_tokens_added_total": len(done.requested), "intermediate_tokens_added": len(between), "synthetic_merges_added": len(done.made),
    }
    lists = {
        "requested_token_deletes": e.delete, "requested_token_renames": [f"{k} {v}" for k, v in e.rename.items()], "requested_token_adds": e.add,
        "existing_ignored_tokens": done.ignored, "requested_added_tokens": done.requested, "intermediate_added_tokens": between,
        "synthetic_merge_pairs": [f"{a} {b}" for a, b in done.made], "special_tokens_kept_literals": sorted(done.kept_special) if special else [],
        "special_tokens_renamed_pairs": [f"{k} {v}" for k, v in sorted(renamed.items())], "special_tokens_dropped_literals": sorted(done.dropped_special),
    }
    schema = ", ".join([*(f"{k} int" for k in counts), *(f"{k} array<string>" for k in lists)])
    row = spark.createDataFrame([(*counts.values(), *lists.values())], schema)
    pair = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "left", "right").alias("p")))), lambda x: x["p"])
    parts = [
        done.gone.agg(F.count(F.lit(1)).cast("int").alias("tokens_deleted_total"), F.array_sort(F.collect_set("token")).alias("deleted_tokens")),
        done.deleted_rules.agg(F.count(F.lit(1)).cast("int").alias("original_merges_deleted"), pair.alias("deleted_merge_pairs")),
        *[df.agg(F.count(F.lit(1)).cast("int").alias(name)) for name, df in (("tokens_before", before), ("tokens_after", done.vocab), ("rules_before", rules_before), ("rules_after", done.rules))],
    ]
    for part in parts:  # one row each
        row = row.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return row


def summary_lines(row: dict) -> list[str]:
    """The counts of a summary that are not 0, then its lists that are not empty, for people."""
    name = lambda k: k.replace("_", " ").capitalize()
    counts = [f"{name(k)}: {v}" for k, v in row.items() if isinstance(v, int) and v]
    return counts + [f"{name(k)}: {', '.join(v)}" for k, v in row.items() if isinstance(v, list) and v]
