import pytest
from pyspark.sql import functions as F

from inkspark.sources import files
from inkspark.streaming import indexing

NOTE = """---
title: First note
tags: [alpha, beta/gamma]
created: 2024-01-01
owner: someone
---
# Heading

See [[Second]] and [[Third|alias]]. #inline #a/b

```python
# no heading
x = 1
```
"""


def put(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def test_vault(spark, tmp_path):
    put(tmp_path, "one.md", NOTE)
    put(tmp_path, "deep/er/café 日本.md", "plain [[One]]")
    put(tmp_path, "skip.txt", "no note")
    put(tmp_path, "tag.md", "---\ntags: single\n---\nbody")
    rows = {r.stem: r for r in files.read_vault(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "café 日本", "tag"}
    one = rows["one"]
    assert one.title == "First note" and one.wikilinks == ["Second", "Third"] and one.created_date == "2024-01-01"
    assert one.tags == ["a/b", "alpha", "beta/gamma", "inline"] and one.extra == '{"owner":"someone"}'
    assert one.content.startswith("# Heading") and one.path.endswith("one.md")
    assert rows["café 日本"].title == "café 日本" and rows["café 日本"].tags == []
    assert rows["tag"].tags == ["single"]


def test_vault_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_vault(spark, str(tmp_path / "none"))
    put(tmp_path, "file.md", "x")
    with pytest.raises(NotADirectoryError):
        files.read_vault(spark, str(tmp_path / "file.md"))
    (tmp_path / "empty").mkdir()
    assert files.read_vault(spark, str(tmp_path / "empty")).count() == 0


CHAT = """# A title

## Metadata
- **Source**: other
- **Total Messages**: 1,234
- **Date**: 2024-05-05
---

### USER (10:00)

Hello

### Assistant

Answer
---
lost

### Human

More

### USER

"""


def test_conversations(spark, tmp_path):
    put(tmp_path, "conversations/20240102_chat.md", CHAT)
    put(tmp_path, "conversations/claude/20249999_x.md", "no heading\n### USER\nhi")
    put(tmp_path, "conversations/INDEX.md", CHAT)
    put(tmp_path, "conversations/none.md", "nothing")
    put(tmp_path, "elsewhere/chat.md", CHAT)
    rows = {r.title: r for r in files.read_conversations(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A title", "20249999_x"}
    a = rows["A title"]
    assert [(t.role, t.content, t.timestamp) for t in a.turns] == [("user", "Hello", "10:00"), ("assistant", "Answer", None), ("user", "More", None)]
    assert a.source == "OTHER" and a.total_messages == 1234 and a.total_characters == 15 and a.date == "2024-05-05"
    x = rows["20249999_x"]
    assert x.source == "CLAUDE" and x.date is None and x.total_messages == 1


def test_cases(spark, tmp_path):
    put(tmp_path, "cases.json", '[{"question": "q", "ground_truth": "a", "expected_sources": ["s"]}, {"question": "only"}]')
    assert [r.question for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect()] == ["q"]


def test_index_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "x", "vault"), ("b", "y", "ai_conversation"), ("c", None, "vault")], "id string, text string, source_type string")
    assert not files.index_exists(spark, path)
    files.write_index(rows, path)
    files.write_index(rows.limit(1), path, "append")
    assert files.index_exists(spark, path) and files.read_index(spark, path).count() == 3
    assert files.read_index(spark, path, ["ai_conversation"]).count() == 1
    with pytest.raises(ValueError):
        files.write_index(rows, path, "other")
    done = str(tmp_path / "done")
    assert files.read_processed(spark, done).count() == 0
    files.mark_processed(rows.select(F.col("id").alias("path")), done)
    assert files.read_processed(spark, done).count() == 3


def test_stream_indexes_new_files_only(spark, tmp_path):
    vault, out, check = (str(tmp_path / x) for x in ("vault", "out", "check"))
    put(tmp_path / "vault", "one.md", NOTE)
    indexing.index_new_files(spark, vault, out, check)
    assert {r.title for r in spark.read.parquet(out).collect()} == {"First note"}
    put(tmp_path / "vault", "two.md", "second text")
    indexing.index_new_files(spark, vault, out, check)
    rows = spark.read.parquet(out).groupBy("title").count().collect()
    assert {r.title: r["count"] for r in rows} == {"First note": 1, "two": 1}
