"""A tokenizer's directory: where it is, its special tokens, and the whole rewrite of its files."""

from __future__ import annotations

import json
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rewrite as R
from ..sources import tokenizer as S
from ..sources.sinks import merges_json, merges_text
from .sanitize import Edits, Sanitized, sanitize, summary

#: Names of files that a rewrite leaves beside the tokenizer's own. Fixed values.
MAPPING, INITIALIZERS, GROUPS = "tokenizer_mapping.json", "tokenizer_added_token_initializers.json", "tokenizer_token_groups.json"
#: Files with special tokens, later ones over earlier ones; files with ids. Fixed values.
SPECIAL_FILES = ("special_tokens_map.json", "tokenizer_config.json")
CONFIG_FILES = ("special_tokens_map.json", "tokenizer_config.json", "config.json", "generation_config.json")
#: The file of all weights of a model, and the index of its parts. Fixed values.
WHOLE, INDEX = "model.safetensors", "model.safetensors.index.json"


def resolve_source(source: str, models_dir: str = "models") -> Path:
    """The directory of a tokenizer: `source` itself, the folder of a file, or a folder of that name below
    models_dir. Nothing is fetched from elsewhere."""
    path = Path(source).expanduser()
    for found in (path if path.is_dir() else None, path.parent if path.is_file() else None, Path(models_dir).expanduser() / source):
        if found is not None and found.is_dir():
            return found.resolve()
    raise FileNotFoundError(f"no tokenizer at {source} or in {models_dir}")


def find_checkpoint(folder: str) -> Path | None:
    """A model's weights: one file where one has them all, else the folder of their parts."""
    held = {p.name: p for p in Path(folder).glob("*.safetensors*")}
    weights = [name for name in held if name.endswith(".safetensors")]
    alone = WHOLE if WHOLE in held else weights[0] if len(weights) == 1 and INDEX not in held else None
    if alone:
        return held[alone]
    return Path(folder) if weights or INDEX in held else None


def read_json(path: Path) -> dict[str, Any]:
    held = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(held, dict):
        raise ValueError(f"{path} holds no JSON object")
    return held


def write_json(path: Path, held: Any) -> None:
    path.write_text(json.dumps(held, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_tokenizer(spark: SparkSession, folder: Path, tokenizer_id: str = "t") -> tuple[DataFrame, DataFrame]:
    """(vocab, merges) of tokenizer.json, or else of vocab.json and merges.txt."""
    if (folder / "tokenizer.json").exists():
        vocab, merges = S.read_tokenizer_json(spark, str(folder / "tokenizer.json"), tokenizer_id)
    elif (folder / "vocab.json").exists() and (folder / "merges.txt").exists():
        vocab, merges = S.read_vocab_json(spark, str(folder / "vocab.json"), tokenizer_id), S.read_merges_txt(spark, str(folder / "merges.txt"), tokenizer_id)
    else:
        raise FileNotFoundError(f"neither tokenizer.json nor vocab.json with merges.txt in {folder}")
    return S.check_unique_ids(vocab), merges


def special_tokens(spark: SparkSession, folder: Path, vocab: DataFrame) -> list[str]:
    """The special tokens of the config files and of the added tokens marked as such, each once, by id. One
    that the vocabulary lacks is an error."""
    paths = [str(folder / f) for f in SPECIAL_FILES if (folder / f).exists()]
    found = {r.literal for r in S.read_special_tokens(spark, paths, "t").collect()} if paths else set()
    body = read_json(folder / "tokenizer.json") if (folder / "tokenizer.json").exists() else {}
    found |= {t["content"] for t in body.get("added_tokens") or [] if isinstance(t, dict) and t.get("special") is True and isinstance(t.get("content"), str)}
    asked = spark.createDataFrame([(t,) for t in sorted(found)], "token string")
    ids = {r.token: r["id"] for r in vocab.join(asked, "token", "left_semi").collect()}
    if missing := sorted(found - ids.keys()):
        raise R.PlanError(f"special tokens without an id: {missing[:8]}")
    return sorted(found, key=lambda t: (ids[t], t))


def sanitize_directory(
    spark: SparkSession, source: str, destination: str, edits: Edits, overwrite: bool = False, reassign: bool = True, text_only: bool = False, models_dir: str = "models"
) -> tuple[Path, DataFrame]:
    """Copies a tokenizer's directory and rewrites the copy: order of the merges and, with `reassign`, special
    tokens, deletions, renames, additions and ids, in tokenizer.json, merges.txt, added_tokens.json and the
    configs. Beside them: copies of the originals, the mapping of ids, what added tokens are made of, and the
    groups of tokens. text_only: configs of the text model alone, no processor. Returns the directory and
    the one-row summary. A destination that exists is an error unless `overwrite`; it is put in place last,
    so a failure leaves what was there."""
    here, there = resolve_source(source, models_dir), Path(destination).expanduser()
    if there.exists() and not overwrite:
        raise FileExistsError(f"{there} exists")
    if (edits.special or edits.tokens) and not reassign:
        raise ValueError("edits of tokens need reassign")
    if (edits.special or edits.tokens) and not (here / "tokenizer.json").exists():
        raise FileNotFoundError("edits of tokens need tokenizer.json")
    vocab, rules = read_tokenizer(spark, here)
    done = sanitize(vocab, rules, special_tokens(spark, here, vocab) if reassign else [], edits)
    row = summary(done, vocab, rules)
    row = spark.createDataFrame(row.collect(), row.schema)  # one row; the files are read no more
    draft = there.parent / f".{there.name}.draft"
    shutil.rmtree(draft, ignore_errors=True)
    shutil.copytree(here, draft)
    if reassign:
        for name in ("tokenizer.json", "tokenizer_config.json"):
            if (draft / name).exists():
                shutil.copy2(draft / name, draft / f"original_{name}")
        _rewrite_ids(draft, done, vocab)
    _rewrite_merges(draft, done.rules)
    if text_only:
        _text_only(draft)
    if there.exists():
        shutil.rmtree(there)
    draft.rename(there)
    return there.resolve(), row


def _rewrite_merges(folder: Path, rules: DataFrame) -> None:
    """The merges in tokenizer.json (pairs or strings, as they were) and merges.txt (its header kept)."""
    wrote = False
    path = folder / "tokenizer.json"
    if path.exists():
        held = read_json(path)
        pairs = json.loads((merges_json(rules).first() or {"body": "[]"})["body"])
        listed = any(isinstance(m, list) for m in held["model"].get("merges") or [[]])
        held["model"]["merges"] = pairs if listed else [" ".join(p) for p in pairs]
        write_json(path, held)
        wrote = True
    path = folder / "merges.txt"
    if path.exists():
        lines = path.read_text(encoding="utf-8").splitlines()
        header = lines[0] if lines and lines[0].startswith("#") else None
        body = merges_text(rules, header).first()
        path.write_text(body["body"] if body else (header or "") + "\n" * bool(header), encoding="utf-8")
        wrote = True
    if not wrote:
        raise FileNotFoundError(f"neither tokenizer.json nor merges.txt in {folder}")


def _rewrite_ids(folder: Path, done: Sanitized, vocab: DataFrame) -> None:
    """Vocabulary, added tokens, post-processor, configs, and the files beside them."""
    remap = done.remap.orderBy("new_id").select("token", "old_id", "new_id").collect()  # one vocabulary
    added = set(done.added)
    mapping = {r.old_id: r.new_id for r in remap if r.token not in added}
    gone = {r.token for r in done.gone.select("token").collect()}
    lost = gone | set(done.dropped_special)
    asked = done.gone.sparkSession.createDataFrame([(t,) for t in sorted(done.dropped_special)], "token string")
    lost_ids = {r["id"] for r in vocab.join(asked, "token", "left_semi").collect()} if done.dropped_special else set()
    literals = {k: v for k, v in (done.kept_special | done.edits.rename).items() if k != v}
    plan = R.ConfigPlan(mapping, literals, frozenset(lost), frozenset(lost_ids))
    path = folder / "tokenizer.json"
    if path.exists():
        held = read_json(path)
        held["model"]["vocab"] = {r.token: r.new_id for r in remap}
        if isinstance(held.get("added_tokens"), list):
            held["added_tokens"] = plan.added_tokens(held["added_tokens"])
        if isinstance(held.get("post_processor"), dict):
            held["post_processor"] = plan.post_processor(held["post_processor"])
        write_json(path, held)
    if (folder / "vocab.json").exists():
        write_json(folder / "vocab.json", {r.token: r.new_id for r in remap})
    for name in CONFIG_FILES:
        if (folder / name).exists():
            own = plan if name != "config.json" else R.ConfigPlan(mapping, literals, plan.dropped, plan.dropped_ids, len(remap))
            write_json(folder / name, json.loads(R.remap_config(json.dumps(read_json(folder / name)), own)))
    if (folder / "added_tokens.json").exists():
        kept = plan.encoder(read_json(folder / "added_tokens.json"))
        write_json(folder / "added_tokens.json", kept if isinstance(kept, dict) else {})
    write_json(folder / MAPPING, {str(k): v for k, v in sorted(mapping.items())})
    if done.added:
        write_json(folder / INITIALIZERS, {str(k): v for k, v in sorted(done.initializers.items())})
    else:
        (folder / INITIALIZERS).unlink(missing_ok=True)
    write_json(folder / GROUPS, token_groups(done))
    for name in ("chat_template.jinja", "chat_template.json"):
        if (folder / name).exists() and (done.dropped_special or literals):
            text = (folder / name).read_text(encoding="utf-8")
            (folder / name).write_text(rewrite_literals(text, {k: v for k, v in done.kept_special.items() if k != v}, done.dropped_special), encoding="utf-8")


def rewrite_literals(text: str, renames: dict[str, str], dropped: list[str]) -> str:
    """`functions.text.replace_literals` of one small text."""
    for old in sorted(renames, key=lambda x: (-len(x), x)):
        text = text.replace(old, renames[old])
    for old in sorted(dropped, key=lambda x: (-len(x), x)):
        text = text.replace(old, "")
    return text


def token_groups(done: Sanitized) -> dict[str, list]:
    """Ids (new) and texts of original, added, requested, intermediate and special tokens."""
    between = [t for t in done.added if t not in done.requested]
    row = R.token_groups(done.remap, list(done.added), done.requested, done.specials).first()
    asked = done.remap.sparkSession.createDataFrame([(t,) for t in done.added], "token string")
    ids = {r.token: r.new_id for r in done.remap.join(asked, "token", "left_semi").collect()} if done.added else {}
    return {
        "original_token_ids": list(row.original_ids), "added_token_ids": [ids[t] for t in done.added], "requested_added_token_ids": [ids[t] for t in done.requested],
        "intermediate_added_token_ids": [ids[t] for t in between], "special_token_ids": list(row.special_ids),
        "added_tokens": list(done.added), "requested_added_tokens": list(done.requested), "intermediate_added_tokens": between, "special_tokens": list(done.specials),
    }


def _text_only(folder: Path) -> None:
    """Configs of the text model alone; no processor."""
    for name, change in (("config.json", R.text_only_config), ("tokenizer_config.json", R.text_only_tokenizer_config)):
        if (folder / name).exists():
            write_json(folder / name, json.loads(change(json.dumps(read_json(folder / name)))))
    (folder / "processor_config.json").unlink(missing_ok=True)


def run_record(settings: dict[str, Any], rows: DataFrame | None = None) -> str:
    """A run's settings (and the first row of a table) as one JSON line, keys by name."""
    held = settings | (rows.first().asDict(recursive=True) if rows is not None else {})
    return json.dumps(held, ensure_ascii=False, sort_keys=True, default=str)


def details(folder: Path, order: str, reassign: bool, text_only: bool) -> list[str]:
    """What a rewrite has left, in three lines for people."""
    held = read_json(folder / "tokenizer.json").get("model", {}) if (folder / "tokenizer.json").exists() else {}
    yes = lambda x: "yes" if x else "no"
    files = ", ".join(f"{name}={yes((folder / f).exists())}" for name, f in (("mapping", MAPPING), ("token_groups", GROUPS), ("added_initializers", INITIALIZERS)))
    return [f"Run: order={order}, reassign={yes(reassign)}, text_only={yes(text_only)}", f"Tokenizer: vocab_size={len(held.get('vocab', {}))}, merge_count={len(held.get('merges', []))}", f"Files: {files}"]
