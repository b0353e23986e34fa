import io
import tarfile
import zipfile

from inkstream.sources import members


def _tar(path, files, mode):
    with tarfile.open(path, mode) as t:
        t.add(path.parent, "folder", recursive=False)
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))


def test_members_of_all_kinds_of_archives(spark, tmp_path):
    files = {f"d/{i}.txt": bytes([i]) * (i * 100) for i in range(20)} | {"./é.txt": b"x"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for n, b in files.items():
            z.writestr(n, b)
    _tar(tmp_path / "b.tar", files, "w")
    _tar(tmp_path / "c.tar.gz", files, "w:gz")
    (tmp_path / "sub").mkdir()
    _tar(tmp_path / "sub" / "d.tgz", {}, "w:gz")
    (tmp_path / "sub" / "plain.txt").write_bytes(b"own")
    found = members.read_members(spark, str(tmp_path), partitionBytes="4000")
    got = {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content) for r in found.collect()}
    assert got == {(a, n): b for a in ("a.zip", "b.tar", "c.tar.gz") for n, b in files.items()} | {("plain.txt", ""): b"own"}
    assert all(r.length == len(r.content) for r in found.collect())
    assert members.read_members(spark, str(tmp_path / "b.tar"), partitionBytes="4000").rdd.getNumPartitions() > 3
    assert members.read_members(spark, str(tmp_path / "none")).collect() == []
    one = found.select(members.place(found).alias("p")).filter("p like '%b.tar/%' and p like '%é%'").first()
    assert one.p == f"{tmp_path}/b.tar/é.txt"


def test_the_first_file_by_folder_and_locale(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/x", "/b/x.en", "/b/x.en_US", "/b/y.fr", "/b/z", "/c/z.de", "/abs", "/abs.en")], "path string")
    asked = [("x", "en_US"), ("y", "fr_CA"), ("z", "de"), ("/abs", "en"), ("none", "en"), ("z", None), ("x", "e"), ("x", "en_US"), (None, "en")]
    out = members.first_found(spark.createDataFrame(asked, "n string, l string"), files, "n", "l", ["/a", "/b/", "/c"])
    got = sorted(((r.n, r.l, r.found) for r in out.collect()), key=repr)
    assert got == sorted([("x", "en_US", "/a/x"), ("y", "fr_CA", "/b/y.fr"), ("z", "de", "/b/z"), ("/abs", "en", "/abs.en"), ("none", "en", None), ("z", None, "/b/z"), ("x", "e", "/a/x"), ("x", "en_US", "/a/x"), (None, "en", None)], key=repr)
