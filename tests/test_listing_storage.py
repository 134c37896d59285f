import hashlib
import os
import random

import pytest

from casegrid.sources import content, listing, storage
from casegrid.sources.files import file_candidates, listed_documents


def touch(root, rel, data=b"x"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def walked(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_uris():
    assert [storage.is_local(u) for u in ("/a/b", "a/b", "file:/a", "file:///a", "s3://b/k", "hdfs://n:1/x", "odd:name/x")] == \
        [True, True, True, True, False, False, True]
    assert storage.local_path("file:///a/b c") == storage.local_path("file:/a/b c") == "/a/b c"
    assert storage.canonical("s3://bucket/dir/") == "s3://bucket/dir"


@pytest.mark.parametrize(("budget", "first", "flat"), [(50_000, 1_000, 20_000), (7, 3, 4), (1, 1, 1)])
def test_rounds_and_slices_list_every_file_once(spark, tmp_path, budget, first, flat):
    root, rnd = str(tmp_path / "tree"), random.Random(budget)
    for i in range(70):
        touch(root, "/".join([f"d{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 5))] + [f"f{i}.txt"]), b"x" * (i % 3))
    for i in range(40):
        touch(root, f"flat/{i}.txt")
        touch(root, f"flat/sub{i % 3}/{i}.txt")
    for rel in (".hidden.txt", "flat/.hidden", ".dot/in.txt", "_dir/_under.txt", "zero.txt"):
        touch(root, rel, b"")
    os.symlink(root, os.path.join(root, "loop"))
    got = listing.list_documents(spark, root, 3, budget=budget, first_budget=first, flat=flat).collect()
    assert sorted(r.rel_path for r in got) == walked(root)
    assert all(r.length == os.path.getsize(os.path.join(root, r.rel_path)) and r.source_file == f"{root}/{r.rel_path}"
               and r.name == r.rel_path.split("/")[-1] and r.id_path == r.rel_path for r in got)


def test_a_flat_directory_goes_to_many_tasks(spark, tmp_path):
    """100,000 files in one directory, in slices of at most 20,000."""
    root = str(tmp_path / "flat")
    os.makedirs(root)
    for i in range(100_000):
        os.close(os.open(f"{root}/{i}.txt", os.O_CREAT | os.O_WRONLY))
    got = listing.list_documents(spark, root)
    assert got.count() == got.select("rel_path").distinct().count() == 100_000
    files, units, _ = listing._directory(root, 0, 1, listing.FLAT)
    assert not files and [u[5:] for u in units] == [(i, 5) for i in range(5)]
    each = [len(listing._directory(root, i, 5, listing.FLAT)[0]) for i in range(5)]
    assert sum(each) == 100_000 and max(each) < 21_000


def test_closed_and_missing_directories_are_empty(spark, tmp_path):
    assert listing.list_documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "some").mkdir()
    assert listing.list_documents(spark, str(tmp_path / "some")).columns == list(listing.LISTING_COLUMNS)


def test_listing_order_is_by_path_parts(spark, tmp_path):
    root = str(tmp_path / "order")
    rels = ["a/x.txt", "a-b/x.txt", "a b/x.txt", "a.txt", "B.TXT", "a/b/c.docx", "nested/c.docx", "ä/é.txt", "a/x/y.txt", "z.txt"]
    for rel in rels:
        touch(root, rel)
    want = sorted(rels, key=lambda r: r.split("/"))
    got = listing.list_documents(spark, root)
    assert [r.rel_path for r in listing.ordered(got).collect()] == want
    placed = {r.position: r.rel_path for r in listing.with_positions(got).collect()}
    assert [placed[i] for i in range(len(rels))] == want


def test_positions_over_many_ranges(spark):
    rnd = random.Random(1)
    rels = ["/".join(rnd.choice("ab-c.é") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 4))) + f"/{i}" for i in range(3000)]
    df = spark.createDataFrame([(r,) for r in rels], "rel_path string").repartition(5)
    got = {r.position: r.rel_path for r in listing.with_positions(df).collect()}
    assert [got[i] for i in range(3000)] == sorted(rels, key=lambda r: r.split("/"))


def sha8(text):
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def test_ids_are_of_resolved_paths(spark, tmp_path):
    root, outside = str(tmp_path / "in"), str(tmp_path / "elsewhere")
    touch(root, "real/Note One.txt", b"order late")
    touch(outside, "far/letter.txt", b"order late")
    os.symlink(f"{root}/real/Note One.txt", f"{root}/alias.txt")
    os.symlink(f"{outside}/far/letter.txt", f"{root}/Linked Letter.txt")
    os.symlink(root, str(tmp_path / "by link"))
    for given in (root, str(tmp_path / "by link"), f"file://{root}"):
        got = {r.name: (r.document_id, r.source_file) for r in listed_documents(spark, given).collect()}
        assert got == {"Note One.txt": (f"note_one_{sha8('real/Note One.txt')}", f"{given}/real/Note One.txt"),
                       "alias.txt": (f"alias_{sha8('real/Note One.txt')}", f"{given}/alias.txt"),
                       "Linked Letter.txt": (f"linked_letter_{sha8('letter.txt')}", f"{given}/Linked Letter.txt")}
    texts = [r.text for r in file_candidates(spark, f"file://{root}").collect()]
    assert texts == ["order late"] * 3


def test_windows_bound_bytes_in_flight():
    lengths = [3, 3, 3, 100, 1, 1, 1, 1, 5, 6]
    got = list(content.windows(lengths, 3, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(10))
    assert all(sum(lengths[a:b]) <= 10 or b - a == 1 for a, b in got) and all(b - a <= 3 for a, b in got)
    assert list(content.windows([], 3, 10)) == []


def test_reading_reports_what_is_gone(spark, tmp_path):
    root = str(tmp_path / "gone")
    for i in range(9):
        touch(root, f"{i}.txt", b"x" * i)
    listed = spark.createDataFrame(listed_documents(spark, root).toPandas())
    os.remove(f"{root}/4.txt")
    for df in (listed, listed.drop("length")):
        got = {r.name: (None if r.content is None else len(r.content), r.read_error)
               for r in content.read_in_tasks(df, max_rows=4, max_bytes=8, readers=3).collect()}
        assert got == {f"{i}.txt": ((i, None) if i != 4 else (None, "DOCUMENT_READ_ERROR")) for i in range(9)}


def test_storage_moves_and_removes(tmp_path):
    a, b = str(tmp_path / "d" / "a"), f"file://{tmp_path}/d/b"
    storage.make_folder(f"file://{tmp_path}/d")
    storage.write_bytes(a, b"1")
    storage.write_bytes(b, b"2")
    storage.move(a, b)
    assert storage.read_bytes(b) == b"1" and not storage.exists(a)
    storage.remove(b)
    storage.remove(b)
    storage.remove_folder(str(tmp_path / "d"))
    storage.remove_folder(str(tmp_path / "d"))
    assert not storage.exists(str(tmp_path / "d"))
