"""Whole directories: rewriting a tokenizer's files, finding sources, comparison files."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.plans import files as D
from lexloom.plans.sanitize import Edits
from lexloom.sources import maps as SM
from lexloom.sources import sinks as SS

from .test_merges import PAIRS, TOKENS


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    vocab = {t: i for i, t in enumerate(TOKENS)} | {"<bos>": 11, "<eos>": 12, "<x>": 13}
    added = [{"id": 12, "content": "<eos>", "special": True}, {"id": 11, "content": "<bos>", "special": True}, {"id": 13, "content": "<x>", "special": False}]
    post = {"type": "TemplateProcessing", "special_tokens": {"<bos>": {"id": 11, "ids": [11], "tokens": ["<bos>"]}, "<eos>": {"id": 12, "ids": [12], "tokens": ["<eos>"]}}}
    D.write_json(folder / "tokenizer.json", {"added_tokens": added, "post_processor": post, "model": {"type": "BPE", "vocab": vocab, "merges": [list(p) for p in PAIRS]}})
    (folder / "merges.txt").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in PAIRS))
    D.write_json(folder / "tokenizer_config.json", {"pad_token": "<pad>", "bos_token": "<bos>", "image_token": "<pad>", "added_tokens_decoder": {"13": {"content": "<x>"}, "11": {"content": "<bos>", "special": True}}})
    D.write_json(folder / "config.json", {"vocab_size": 14, "bos_token_id": 11, "eos_token_id": [12], "pad_token_id": 0, "text_config": {"vocab_size": 14, "hidden_size": 4}})
    D.write_json(folder / "added_tokens.json", {"<x>": 13, "<bos>": 11})
    (folder / "chat_template.jinja").write_text("{{ '<bos>' }}{{ m }}<eos>")
    (folder / "processor_config.json").write_text("{}")
    return folder


def read(folder, name):
    return json.loads((folder / name).read_text(encoding="utf-8"))


def test_order_and_ids(spark, source, tmp_path):
    out, row = D.sanitize_directory(spark, str(source), str(tmp_path / "out"), Edits())
    vocab = read(out, "tokenizer.json")["model"]["vocab"]
    assert list(vocab) == ["<pad>", "<bos>", "<eos>", "<x>", "a", "b", "c", "x", "y", "z", "ab", "xy", "abc", "xyz"] and list(vocab.values()) == list(range(14))
    assert read(out, "tokenizer.json")["model"]["merges"] == [["a", "b"], ["x", "y"], ["ab", "c"], ["xy", "z"]]
    assert (out / "merges.txt").read_text() == "#version: 0.2\na b\nx y\nab c\nxy z\n"
    mapping = read(out, D.MAPPING)
    assert list(mapping) == [str(i) for i in range(14)] and mapping["8"] == 10 and SM.read_id_mapping(spark, str(out / D.MAPPING))[11] == 1
    assert [(t["id"], t["content"]) for t in read(out, "tokenizer.json")["added_tokens"]] == [(1, "<bos>"), (2, "<eos>"), (3, "<x>")]
    assert read(out, "tokenizer.json")["post_processor"]["special_tokens"]["<eos>"] == {"id": 2, "ids": [2], "tokens": ["<eos>"]}
    assert read(out, "config.json")["eos_token_id"] == [2] and list(read(out, "tokenizer_config.json")["added_tokens_decoder"]) == ["1", "3"]
    assert read(out, "added_tokens.json") == {"<bos>": 1, "<x>": 3}
    assert read(out, "original_tokenizer.json") == read(source, "tokenizer.json") and not (out / D.INITIALIZERS).exists()
    groups = SM.read_token_groups(spark, str(out / D.GROUPS))
    assert groups["special_tokens"] == ["<pad>", "<bos>", "<eos>"] and groups["special_token_ids"] == [0, 1, 2] and groups["added_tokens"] == []
    assert D.details(out, "good", True, False)[1] == "Tokenizer: vocab_size=14, merge_count=4"
    with pytest.raises(FileExistsError):
        D.sanitize_directory(spark, str(source), str(out), Edits())
    again, _ = D.sanitize_directory(spark, str(source), str(out), Edits(order="original"), overwrite=True, reassign=False)
    assert read(again, "tokenizer.json") == read(source, "tokenizer.json") and not (again / D.MAPPING).exists()
    with pytest.raises(ValueError):
        D.sanitize_directory(spark, str(source), str(tmp_path / "no"), Edits(delete=["ab"]), reassign=False)
    assert not (tmp_path / "no").exists()


def test_edits_in_files(spark, source, tmp_path):
    edits = Edits(delete=["ab"], add=["ayz", "a"], rename={"xy": "XY", "<x>": "<X>"}, keep_special=["<pad>"], rename_special={"<bos>": "<start>"})
    out, row = D.sanitize_directory(spark, str(source), str(tmp_path / "out"), edits, text_only=True)
    held = read(out, "tokenizer.json")
    assert list(held["model"]["vocab"]) == ["<pad>", "<start>", "<X>", "a", "b", "c", "x", "y", "z", "yz", "ayz", "XY", "xyz"]
    assert held["model"]["merges"] == [["y", "z"], ["a", "yz"], ["x", "y"], ["XY", "z"]]
    assert [t["content"] for t in held["added_tokens"]] == ["<start>", "<X>"]
    assert list(held["post_processor"]["special_tokens"]) == ["<start>"]
    assert read(out, D.INITIALIZERS) == {"9": [2, 6], "10": [3, 2, 6]}
    config = read(out, "tokenizer_config.json")
    assert config["bos_token"] == "<start>" and "image_token" not in config and [t["content"] for t in config["added_tokens_decoder"].values()] == ["<start>", "<X>"]
    assert read(out, "config.json") == {"vocab_size": 13, "hidden_size": 4, "architectures": ["Gemma4ForCausalLM"], "model_type": "gemma4_text"}
    assert read(out, "added_tokens.json") == {"<start>": 1, "<X>": 2} and not (out / "processor_config.json").exists()
    assert (out / "chat_template.jinja").read_text() == "{{ '<start>' }}{{ m }}"
    one = row.first()
    assert (one.special_tokens_dropped_literals, one.requested_added_tokens, one.existing_ignored_tokens, one.deleted_merge_pairs) == (["<eos>"], ["ayz"], ["a"], ["a b", "ab c"])
    groups = read(out, D.GROUPS)
    assert groups["requested_added_token_ids"] == [10] and groups["intermediate_added_tokens"] == ["yz"] and groups["special_token_ids"] == [0, 1]
    assert json.loads(D.run_record({"order": "good"}, row))["tokens_after"] == 13


def test_sources(spark, source, tmp_path):
    assert D.resolve_source(str(source)) == D.resolve_source(str(source / "merges.txt")) == D.resolve_source("source", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        D.resolve_source("nowhere", str(tmp_path))
    plain = tmp_path / "plain"
    plain.mkdir()
    D.write_json(plain / "vocab.json", {"a": 0, "b": 1, "ab": 2})
    (plain / "merges.txt").write_text("a b\n")
    vocab, merges = D.read_tokenizer(spark, plain)
    assert vocab.count() == 3 and [(r.left, r.right) for r in merges.collect()] == [("a", "b")]
    out, _ = D.sanitize_directory(spark, str(plain), str(tmp_path / "plain-out"), Edits())
    assert (out / "merges.txt").read_text() == "a b\n" and read(out, "vocab.json") == {"a": 0, "b": 1, "ab": 2}
    with pytest.raises(FileNotFoundError):
        D.read_tokenizer(spark, tmp_path)
    assert D.find_checkpoint(str(plain)) is None
    (plain / "x-1.safetensors").write_text("")
    assert D.find_checkpoint(str(plain)).name == "x-1.safetensors"
    (plain / "x-2.safetensors").write_text("")
    assert D.find_checkpoint(str(plain)) == plain
    (plain / "model.safetensors").write_text("")
    assert D.find_checkpoint(str(plain)).name == "model.safetensors"
    (tmp_path / "init.json").write_text('{"7": [1, 2], "9": [0]}')
    assert SM.read_initializers(spark, str(tmp_path / "init.json")) == {7: [1, 2], 9: [0]}
    for bad in ('{"7": []}', '{"x": [1]}', '{"7": [true]}', '{"7": 1}'):
        (tmp_path / "init.json").write_text(bad)
        with pytest.raises(ValueError):
            SM.read_initializers(spark, str(tmp_path / "init.json"))
    (tmp_path / "special.json").write_text('{"keep": ["<a>"], "rename": {"<b>": "<c>"}}')
    assert SM.read_special_map(spark, str(tmp_path / "special.json")) == (["<a>"], {"<b>": "<c>"})
    (tmp_path / "special.json").write_text('{"keep": ["<b>"], "rename": {"<b>": "<c>"}}')
    with pytest.raises(ValueError):
        SM.read_special_map(spark, str(tmp_path / "special.json"))


def test_comparison_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 == 0, None) for i in range(50)], "id long, any_mismatch boolean, judge_match boolean").repartition(5)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    SS.write_comparison(rows, total, str(tmp_path / "c"), order="id")
    lines = [json.loads(x) for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines[:-1]] == list(range(50)) and lines[-1] == {"summary": {"total": 50}} and lines[0]["judge_match"] is None
    SS.write_comparison(rows, total, str(tmp_path / "m"), only_mismatches=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 18 and "summary" in lines[-1]
    assert SS.mismatch_lines(rows, total).count() == 18
    rules = spark.createDataFrame([("t", 1, "b", "c"), ("t", 0, "a", "b")], "tokenizer_id string, place int, left string, right string")
    assert SS.merges_json(rules).first().body == '[["a","b"],["b","c"]]'
