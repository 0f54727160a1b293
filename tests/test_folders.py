"""Push to and pull from a folder of markdown files."""

import datetime as dt
import os

from memloom.sources import files

AT = dt.datetime(2024, 1, 1)
SCHEMA = "id long, title string, content string, tags array<string>, created_at timestamp, updated_at timestamp"


def notes(spark, rows):
    return spark.createDataFrame([(i, t, c, tags, AT, AT) for i, t, c, tags in rows], SCHEMA)


def changes(df):
    return sorted(((r["op"], r["id"], r["title"], r["content"], r["tags"]) for r in df.collect()), key=repr)


def test_folder_and_table_agree(spark, tmp_path):
    path = f"{tmp_path}/remote"
    rows = [(1, "Plain", "one\n\ntwo\n", ["a", "b"]), (2, "a/b: c+d %41", "Äpfel [[x]]", []), (3, "Empty", None, None), (4, None, "no title", []), (5, "Plain", "the later note of this title", [])]
    df = notes(spark, rows)
    assert files.push_folder(df, path, "here") == 3
    assert sorted(f for f in os.listdir(path) if f.endswith(".md")) == ["Empty.md", "Plain.md", "a_b__c+d_%41.md"]
    assert open(f"{path}/a_b__c+d_%41.md").read() == "---\nid: 2\ntags: []\ncreated: 2024-01-01T00:00:00+00:00\nupdated: 2024-01-01T00:00:00+00:00\ndevice: here\n---\nÄpfel [[x]]\n"
    assert files.push_folder(df, path, "here") == 0 and changes(files.pull_folder(df.filter("id <> 1"), path)) == []
    assert [d for d in os.listdir(tmp_path) if "staging" in d] == []
    with open(f"{path}/New one.md", "w") as f:
        f.write("---\ntags: [z]\n---\nfresh #tag #tag text\n")
    with open(f"{path}/Empty.md", "w") as f:
        f.write("no header, now full")
    got = changes(files.pull_folder(df.filter("id <> 1"), path))
    assert got == [("create", None, "New one", "fresh #tag #tag text", ["tag"]), ("update", 3, "Empty", "no header, now full", None)]
    pulled = [(2, *rows[1][1:]), (3, "Empty", "no header, now full", []), (5, *rows[4][1:]), (6, "New one", "fresh #tag #tag text", ["tag"])]
    after = notes(spark, pulled)
    assert changes(files.pull_folder(after, path)) == []
    assert files.push_folder(after, path, "here") == 2 and files.push_folder(after, path, "here") == 0
    assert changes(files.pull_folder(after, path)) == []


def test_nothing(spark, tmp_path):
    none = notes(spark, [])
    assert files.push_folder(none, f"{tmp_path}/r") == 0 and changes(files.pull_folder(none, f"{tmp_path}/r")) == []
    assert files.folder_files(spark, f"{tmp_path}/absent").count() == 0
