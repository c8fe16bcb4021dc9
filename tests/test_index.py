import json

import pytest
from pyspark.sql import functions as F

from pagelode.config import SearchConfig, model_profile, resolve_config
from pagelode.operators import incremental as inc
from pagelode.operators import nav
from pagelode.plans.build import build_index, index_directory
from pagelode.plans.client import SearchClient
from pagelode.plans.embed import HashingEmbedder
from pagelode.sources.store import IndexStore, Manifest, read_flat_index


def test_config_layers():
    assert SearchConfig().chunk_size == 256 and model_profile("no/such").dimensions == 384
    got = resolve_config({"chunkSize": 512, "include": ["**/*.md"], "topK": None}, {"model": "m", "chunkSize": 9}, chunk_overlap=16)
    assert (got.chunk_size, got.chunk_overlap, got.include, got.model, got.top_k) == (512, 16, ("**/*.md",), "m", 10)
    with pytest.raises(ValueError):
        SearchConfig(top_k=-1)


def write_tree(root):
    files = {
        "index.md": "# Start\n\nwelcome to the harbour\n\n## More\n\nboats and ropes\n", "guide.md": "# Guide\n\nhow to sail\n\n## Wind\n\nwind from the west\n\n## Rain\n\nstay inside\n",
        "api.md": "# Api\n## One\n\nfirst call\n", "advanced/plugins.md": "# Plugins\n## Use\n\nwrite a plugin for sails\n", "node_modules/fake/index.md": "# no\n\nhidden harbour\n",
        "data.json": "{}", "empty.md": "",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_directory_build_search_and_refresh(spark, tmp_path):
    root = tmp_path / "docs"
    write_tree(root)
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.manifest() is None and not store.searchable()
    with pytest.raises(FileNotFoundError):
        SearchClient(spark, store.path).load()
    config = SearchConfig(include=("**/*.md",), chunk_size=16, chunk_overlap=2)
    done = index_directory(spark, str(root), store, HashingEmbedder(16), config)
    assert (done.status, done.total_files, done.batch_count) == ("complete", 5, 1) and store.searchable()
    assert {r["file"] for r in store.chunks().select("file").collect()} == {"index.md", "guide.md", "api.md", "advanced/plugins.md"}
    assert {(r["path"], r["size"]) for r in store.files().collect()} >= {("empty.md", 0)}
    client = SearchClient(spark, store.path)
    with pytest.raises(RuntimeError):
        client.search("sail")
    client.load()
    assert client.ready and client.progress() == (1, 1) and client.chunk_count() == store.chunks().count()
    hits = client.search("sail", 5).collect()
    assert {h["file"] for h in hits} == {"guide.md", "advanced/plugins.md"}
    store.export_navigation()
    tree = json.loads((tmp_path / "index" / "navigation.json").read_text())["tree"]
    assert [n["path"] for n in tree if n.get("children")] == ["advanced"]
    # nothing changed: nothing is written
    before = sorted(r["chunk_id"] for r in store.chunks().collect())
    assert index_directory(spark, str(root), store, HashingEmbedder(16), config) == done
    # one file modified, one removed: old chunks go, others stay
    (root / "guide.md").write_text("# Guide\n\nhow to row a boat instead\n")
    (root / "api.md").unlink()
    again = index_directory(spark, str(root), store, HashingEmbedder(16), config)
    assert again.batch_count == 2 and again.total_files == 4
    texts = {r["file"]: r["text"] for r in store.chunks().collect()}
    assert "row a boat" in texts["guide.md"] and "api.md" not in texts
    ids = [r["chunk_id"] for r in store.chunks().collect()]
    assert len(ids) == len(set(ids)) and set(ids) != set(before)
    assert {h["file"] for h in SearchClient(spark, store.path).load().search("wind rain", 5).collect()} == set()


def test_incremental_equals_rebuild(spark, tmp_path):
    rows = [(f"f{i}.md", f"# H{i}\n\nword{i} common text {i}", float(i), i) for i in range(30)]
    schema = "path string, text string, mtime double, size long"
    config = SearchConfig(chunk_size=8, chunk_overlap=2)
    a, b = IndexStore(spark, str(tmp_path / "a")), IndexStore(spark, str(tmp_path / "b"))
    build_index(spark, spark.createDataFrame(rows, schema), a, HashingEmbedder(8), config)
    changed = [(p, t + " more", m + 0.5, s) if i % 3 == 0 else (p, t, m, s) for i, (p, t, m, s) in enumerate(rows)][2:]
    build_index(spark, spark.createDataFrame(changed, schema), a, HashingEmbedder(8), config)
    build_index(spark, spark.createDataFrame(changed, schema), b, HashingEmbedder(8), config)
    view = lambda s: sorted((r["file"], r["text"]) for r in s.chunks().collect())
    assert view(a) == view(b)
    assert a.vectors().count() == a.chunks().count()


def test_round_trips(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(0, "rope.txt", None, "Nine knots hold", (3, 40), 0), (1, "sail.txt", "Cloth", "Canvas tears late", (40, 77), 1)],
        "chunk_id long, file string, heading string, text string, range struct<start:long,end:long>, batch_id int",
    )
    codes = [90, -61, 7, -128, 44, -9, 0, 126, -43]
    vectors = spark.createDataFrame([(0, codes, 0), (1, [1] * 9, 1)], "chunk_id long, vector array<tinyint>, batch_id int")
    for kind, want in (("none", codes), ("ternary", [127, -127, 0, -127, 127, 0, 0, 127, -127])):
        store = IndexStore(spark, str(tmp_path / kind))
        store.update_manifest(model="m", dimensions=9, status="complete")
        store.save_batches(chunks, vectors, 9, kind)
        assert store.vectors().where("chunk_id = 0").first()["vector"] == want
        assert [r["text"] for r in store.chunks().orderBy("batch_id").collect()] == ["Nine knots hold", "Canvas tears late"]
        assert store.batch(1)[0].count() == 1 and store.batches_upto(1).count() == 1
        assert {tuple(r) for r in store.batch_meta().collect()} == {(0, 9, kind, 1), (1, 9, kind, 1)}
        store.save_batches(chunks.where("batch_id = 1").withColumn("text", F.lit("new")), vectors.where("batch_id = 1"), 9, kind)
        assert {r["text"] for r in store.chunks().collect()} == {"Nine knots hold", "new"} and store.vectors().count() == 2
    assert store.manifest() == Manifest("m", 9, status="complete", batch_count=2, total_chunks=2, run=2)
    done = store.save_whole(chunks, vectors, "m2", 9)
    assert (done.batch_count, done.total_chunks, done.status) == (1, 2, "complete") and store.chunks().where("batch_id = 0").count() == 2
    store.vacuum()
    assert store.chunks().count() == 2 and not (tmp_path / "ternary" / "chunks" / "run=1").exists()
    (tmp_path / "none" / "manifest.json").write_text("{broken")
    assert IndexStore(spark, str(tmp_path / "none")).manifest() is None


STEPS = ["write_chunks", "bury", "write_vectors", "write_files", "write_navigation", "save_manifest"]


@pytest.mark.parametrize("step, rebuild", [*[(s, False) for s in STEPS], ("write_chunks", True), ("save_manifest", True)])
def test_a_run_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step, rebuild):
    schema = "path string, text string, mtime double, size long"
    rows = [(f"f{i}.md", f"# H{i}\n\nword{i} text {i}", float(i), i) for i in range(6)]
    later = [(p, t + " edited", m + 1, s) if i == 2 else (p, t, m, s) for i, (p, t, m, s) in enumerate(rows)][1:]
    config = SearchConfig(chunk_size=8, chunk_overlap=2)
    changed = SearchConfig(model="other", chunk_size=8, chunk_overlap=2) if rebuild else config
    store = IndexStore(spark, str(tmp_path / "a"))
    build_index(spark, spark.createDataFrame(rows, schema), store, HashingEmbedder(8), config)
    view = lambda s: sorted((r["file"], r["text"]) for r in s.chunks().collect())
    before = view(store)
    whole = getattr(IndexStore, step)
    calls = []

    def dies(self, *args):
        calls.append(step)
        if step != "save_manifest":
            whole(self, *args)  # all of it is written, but the run ends here
        elif len(calls) == 1:
            return whole(self, *args)
        raise OSError("lost")

    monkeypatch.setattr(IndexStore, step, dies)
    with pytest.raises(OSError):
        build_index(spark, spark.createDataFrame(later, schema), store, HashingEmbedder(8), changed)
    monkeypatch.setattr(IndexStore, step, whole)
    assert store.manifest().status == "indexing" and view(store) == before  # readers keep what they had
    done = build_index(spark, spark.createDataFrame(later, schema), store, HashingEmbedder(8), changed)
    fresh = IndexStore(spark, str(tmp_path / "b"))
    build_index(spark, spark.createDataFrame(later, schema), fresh, HashingEmbedder(8), changed)
    assert view(store) == view(fresh) and (done.status, done.total_files, done.total_chunks) == ("complete", 5, len(view(fresh)))
    ids = [r["chunk_id"] for r in store.chunks().collect()]
    assert len(ids) == len(set(ids)) and store.vectors().count() == len(ids)
    assert sorted(r["path"] for r in store.files().collect()) == sorted(r["path"] for r in fresh.files().collect())


def test_ordinals_with_other_columns(spark):
    """More rows than the range sample holds, and columns that one of the two reads does not need."""
    from pagelode.operators.ordinal import with_ordinal

    rows = spark.range(400_000).selectExpr("(id * 7919) % 400000 AS k", "concat('text ', id) AS text", "id % 3 AS other")
    got = with_ordinal(rows, ("k",), "n").agg(F.countDistinct("n"), F.max("n"), F.count_if(F.col("n") == F.col("k")), F.max(F.length("text"))).first()
    assert got[:3] == (400_000, 399_999, 400_000)
    assert with_ordinal(rows.limit(0), ("k",), "n").count() == 0


def test_flat_index(spark, tmp_path):
    (tmp_path / "search-index.json").write_text(json.dumps({"version": 1, "model": "m", "dimensions": 2, "chunks": [
        {"file": "a", "text": "x", "range": [0, 1]}, {"file": "b", "heading": "h", "text": "y", "range": [1, 2]}]}))
    (tmp_path / "search-index.bin").write_bytes(bytes([1, 255, 2, 128]))
    told = []
    client = SearchClient(spark, str(tmp_path)).load(on_batch_loaded=lambda *n: told.append(n))
    assert client.ready and client.store.searchable() and told == [(1, 1)] and client.progress() == (1, 1)
    assert [(r["file"], r["kw"]) for r in client.search("y").collect()] == [("b", 0.4)]
    chunks, vectors, info = read_flat_index(spark, str(tmp_path))
    assert [(r["chunk_id"], r["heading"], r["range"]["end"]) for r in chunks.orderBy("chunk_id").collect()] == [(0, None, 1), (1, "h", 2)]
    assert [r["vector"] for r in vectors.orderBy("chunk_id").collect()] == [[1, -1], [2, -128]] and info["dimensions"] == 2


def test_manifest_operators(spark):
    schema = "path string, mtime double, size long, batches array<int>"
    now = spark.createDataFrame([("a", 1.0, 1, None), ("b", 2.5, 1, None), ("c", 1.0, 1, None), ("n", None, 1, None)], schema)
    old = spark.createDataFrame([("a", 1.0, 1, [0]), ("b", 2.0, 1, [1]), ("gone", 1.0, 1, [2]), ("n", None, 1, [3])], schema)
    assert {tuple(r) for r in inc.changed_files(now, old).collect()} == {("b", "modified"), ("c", "new")}
    assert {r[0] for r in inc.unchanged_files(now, old).collect()} == {"a", "n"}
    assert {r[0] for r in inc.deleted_files(now, old).collect()} == {"gone"}
    assert {r[0]: r[3] for r in inc.upsert_manifest(old, now).collect()} == {"a": [0], "b": [1], "c": [], "n": [3]}
    assert inc.upsert_manifest(old, now, drop_deleted=False).count() == 5
    git = spark.createDataFrame([(" M a",), ("?? x/y",), (" D c",), ("D  c",), ("",), (None,)], "line string")
    named = inc.parse_git_status(git)
    assert {r[0] for r in named.collect()} == {"a", "x/y"}
    assert {r[0] for r in inc.detect_changes(now, old, named).collect()} == {"a"}
    assert {r[0] for r in inc.detect_changes(now, old, named.where("path = 'x/y'")).collect()} == {"b", "c"}
    assert inc.changed_files(now.limit(0), old).count() == 0


def test_navigation(spark):
    files = spark.createDataFrame(
        [("weather-signs.md", "Signs of Weather"), ("boats/oars.md", None), ("boats/deep_hull.md", ""), ("Tides/neap.md", "Neap Tides"), ("a-b.md", None), (None, "x")],
        "path string, title string",
    )
    nodes = nav.nav_nodes(files)
    tree = nav.nested_tree(nodes)
    assert [n["title"] for n in tree] == ["A B", "Boats", "Tides", "Signs of Weather"]
    assert [c["title"] for c in tree[1]["children"]] == ["Deep Hull", "Oars"]
    heads = spark.createDataFrame([("f", 3, "b"), ("f", 1, None), ("f", 2, "a"), ("g", 1, None)], "file string, chunk_id long, heading string")
    assert {r[0]: r[1] for r in nav.first_headings(heads).collect()} == {"f": "a", "g": ""}


def test_stream_is_exactly_once(spark, tmp_path, monkeypatch):
    from pagelode.streaming.progressive import finish, progress, progressive_index

    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("# H\nword "), F.col("id").cast("string")).alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "index"))
    run = lambda: progressive_index(spark, str(tmp_path / "in"), docs.schema, store, str(tmp_path / "state"), embedder=HashingEmbedder(64))
    whole, calls = IndexStore.save_manifest, []

    def dies(self, manifest):
        calls.append(manifest)
        whole(self, manifest)
        if len(calls) == 2:
            raise OSError("lost after it counted")

    monkeypatch.setattr(IndexStore, "save_manifest", dies)
    query = run()
    with pytest.raises(Exception):
        query.awaitTermination()
    assert store.manifest().batch_count == 2 and store.manifest().status == "indexing"
    monkeypatch.setattr(IndexStore, "save_manifest", whole)
    query = run()
    query.awaitTermination()
    assert len(progress(query)) >= 1
    ids = [r["chunk_id"] for r in store.chunks().collect()]
    assert len(ids) == len(set(ids)) == 30 == store.vectors().count() and store.manifest().batch_count >= 3
    told = []
    client = SearchClient(spark, store.path).load(on_batch_loaded=lambda *n: told.append(n))
    assert told == [(i, store.manifest().batch_count) for i in range(1, store.manifest().batch_count + 1)] and client.search("word 7", 50).count() == 30
    docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    run().awaitTermination()
    assert store.chunks().count() == 35 and finish(store).status == "complete"


def test_folder_settings_and_git(spark, tmp_path, monkeypatch):
    import subprocess

    from pagelode.config import save_user_config, write_json
    from pagelode.sources import files

    root = tmp_path / "docs"
    write_tree(root)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    save_user_config(str(tmp_path / "home"), {"model": "m"})
    write_json(str(root / ".pagelode" / "config.json"), {"include": ["**/*.md"], "chunkSize": 16, "chunkOverlap": 2})
    store = IndexStore(spark, str(tmp_path / "index"))
    told = []
    done = index_directory(spark, str(root), store, HashingEmbedder(8), progress=lambda *p: told.append(p[0]))
    assert (done.model, done.total_files) == ("m", 5) and told == ["crawling", "chunking", "saving", "embedding", "complete"]
    assert files.git_status(spark, str(root)) is None and not files.is_git_root(str(tmp_path / "none"))
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "x")
    assert files.is_git_root(str(root)) and files.git_status(spark, str(root)).count() == 0
    (root / "guide.md").write_text("# Guide\n\nhow to row a boat instead\n")
    (root / "api.md").touch()  # git knows that nothing changed in it
    index_directory(spark, str(root), store, HashingEmbedder(8), use_git=True)
    assert store.view("chunks", store.chunks().schema, store.manifest()).where("run = 2").select("file").distinct().collect() == [("guide.md",)]


def test_listing_prunes_and_reads(spark, tmp_path):
    from pagelode.sources import files

    root = tmp_path / "docs"
    write_tree(root)
    (root / "bad.md").write_bytes(b"\xff ok")
    got = {r["path"]: r for r in files.read_documents(spark, str(root), ["**/*.md"], ["**/node_modules/**"]).collect()}
    assert set(got) == {"index.md", "guide.md", "api.md", "advanced/plugins.md", "empty.md", "bad.md"}
    assert got["empty.md"]["text"] == "" and got["bad.md"]["text"] == "\ufffd ok" and got["index.md"]["mtime"] > 1e12
    assert files.closed_folder(["**/node_modules/**"]).match("x/node_modules/") and not files.closed_folder(["**/b/**"]).match("ab/")
    listed = files.list_files(spark, f"file://{root}", ["**/*.json"], [])
    assert [(r["path"], r["size"]) for r in listed.collect()] == [("data.json", 2)]
    (tmp_path / "void").mkdir()
    assert files.list_files(spark, str(tmp_path / "void"), ["**"], []).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """One protobuf field: an integer, or bytes of known length."""
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(path, table):
    """An ONNX model that looks rows of a table up: input_ids and attention_mask in, hidden states out."""
    import numpy as np

    weights = np.asarray(table, dtype=np.float32)
    tensor = b"".join(field(1, d) for d in weights.shape) + field(2, 1) + field(8, b"w") + field(9, weights.tobytes())
    shape = lambda names: b"".join(field(1, field(2, n)) for n in names)
    info = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(dims))))
    nodes = [field(1, b"w") + field(1, b"input_ids") + field(2, b"hidden") + field(4, b"Gather")]
    graph = b"".join(field(1, n) for n in nodes) + field(2, b"g") + field(5, tensor)
    graph += field(11, info(b"input_ids", 7, [b"n", b"l"])) + field(12, info(b"hidden", 1, [b"n", b"l", b"d"]))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(2, 13)))


def test_onnx_and_table_embedders(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from pagelode.plans.embed import OnnxEmbedder, TableEmbedder, load_model

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "red": 1, "blue": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tok.json"))
    tiny_model(tmp_path / "m.onnx", [[0, 0, 1], [1, 0, 0], [0, 1, 0]])
    chunks = spark.createDataFrame([(1, "red blue"), (2, "red"), (3, None), (4, ""), (5, "green red red red")], "chunk_id long, text string")
    got = {r["chunk_id"]: r["embedding"] for r in OnnxEmbedder(str(tmp_path / "m.onnx"), str(tmp_path / "tok.json"), 3, batch=2).embed(chunks).collect()}
    assert got[1] == pytest.approx([0.5**0.5, 0.5**0.5, 0]) and got[2] == pytest.approx([1, 0, 0]) and got[3] is None is got[4]
    assert got[5] == pytest.approx([3 / 10**0.5, 0, 1 / 10**0.5])
    assert load_model(str(tmp_path / "m.onnx"), str(tmp_path / "tok.json")) is load_model(str(tmp_path / "m.onnx"), str(tmp_path / "tok.json"))
    known = spark.createDataFrame([(1, [0.5, 1.0])], "chunk_id long, embedding array<float>")
    assert {r["chunk_id"]: r["embedding"] for r in TableEmbedder(known, 2).embed(chunks).collect()} == {1: [0.5, 1.0], 2: None, 3: None, 4: None, 5: None}
