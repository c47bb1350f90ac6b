"""Column functions on the published cases and on odd values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import media as M
from tessella.functions import paths as P
from tessella.functions import texts as X
from tessella.functions import times as T
from tessella.functions.vectors import cosine, from_blob, to_blob


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "kind"), [("a/B.JPG", "photo"), ("x\\y.mov", "video"), ("a.txt", None), ("noext", None)])
def test_media_type(spark, path, kind):
    assert value(spark, P.media_type(F.lit(path))) == kind


@pytest.mark.parametrize(("path", "hit"), [("/a/Vault/x.jpg", True), ("C:\\.VAULT\\x", True), ("/a/vaults/x", False), ("/a/my_vault/x", False)])
def test_vault(spark, path, hit):
    assert value(spark, P.is_vault(F.lit(path))) is hit


def test_workspace(spark):
    roots = F.array(F.lit("/u/ann/"))
    ok = lambda p: value(spark, P.in_workspace(F.lit(p), roots))
    assert ok("/u/ann") and ok("/u/ann/x") and not ok("/u/anna/x") and not ok("/u/ann/../bob/x")
    assert value(spark, P.in_workspace(F.lit("/x"), roots, F.lit(True)))


@pytest.mark.parametrize(("wanted", "hit"), [("trip", True), ("/photos/trip/", True), ("photos", True), ("tri", False), ("", False), ("elsewhere/trip", True), ("/photos/trip/a.jpg", True)])
def test_folder(spark, wanted, hit):
    assert value(spark, P.matches_folder(F.lit("/photos/trip/a.jpg"), F.lit("/photos/trip"), F.lit(wanted))) is hit


def test_sidecar_path(spark):
    p = F.lit("C:\\Photos\\trip\\a.jpg")
    assert value(spark, P.sidecar_path(p, "c:/photos", "/out")) == "/out/trip/a.jpg.json"
    assert value(spark, P.sidecar_path(p, "c:/photos", "/out", False)) == "/out/a.jpg.json"
    assert value(spark, P.sidecar_path(p, "d:/other", "/out")) == "/out/a.jpg.json"


@pytest.mark.parametrize(("name", "hit"), [("FACE_ID_01", True), ("face-2", True), ("Person_3", True), ("Unknown", True), (None, True), (" ", True), ("Faceless", False), ("Ann", False)])
def test_placeholder(spark, name, hit):
    assert value(spark, P.is_placeholder_name(F.lit(name).cast("string"))) is hit


@pytest.mark.parametrize(("text", "at"), [("2024:01:02 03:04:05", 1704164645), ("2024-01-02T03:04:05.5Z", 1704164645), ("bad", None), (None, None)])
def test_datetime(spark, text, at):
    assert value(spark, F.unix_timestamp(T.parse_datetime(F.lit(text).cast("string")))) == at


def test_datetime_falls_back(spark):
    assert value(spark, F.unix_timestamp(T.parse_datetime(F.lit(""), F.lit(7.0)))) == 7


@pytest.mark.parametrize(("s", "text"), [(0, "00:00"), (75, "01:15"), (3600, "60:00")])
def test_minutes(spark, s, text):
    assert value(spark, T.minutes(F.lit(s))) == text


@pytest.mark.parametrize(("text", "s", "strict"), [("01:15", 75, 75), ("01:00:02", 3602, 0), ("x", 0, 0), (None, 0, 0)])
def test_seconds(spark, text, s, strict):
    t = F.lit(text).cast("string")
    assert value(spark, T.seconds(t)) == s and value(spark, T.seconds(t, strict=True)) == strict


def test_degrees(spark):
    dms = F.array(F.lit(30.0), F.lit(15.0), F.lit(50.0))
    assert value(spark, M.degrees(dms, F.lit("N"))) == pytest.approx(30.263889, abs=1e-6)
    assert value(spark, M.degrees(dms, F.lit("S"))) == pytest.approx(-30.263889, abs=1e-6)
    assert value(spark, M.degrees(F.array(F.lit(1.0), F.lit(2.0)), F.lit("N"))) is None
    assert value(spark, M.position(dms, F.lit("N"), dms, F.lit(None).cast("string"))).asDict() == {"latitude": None, "longitude": None}


def test_exif_text(spark):
    assert value(spark, M.exposure(F.lit(0.004))) == "0.00400" and value(spark, M.exposure(F.lit(2.0))) == "2.0" and value(spark, M.aperture(F.lit(2))) == "f/2.0"
    assert value(spark, M.rate(F.lit("30000/1001"))) == pytest.approx(29.97003) and value(spark, M.rate(F.lit("5/0"))) == 0 and value(spark, M.rate(F.lit("x"))) == 0
    assert value(spark, M.megapixels(F.lit(4000), F.lit(3000))) == 12.0 and value(spark, M.megapixels(F.lit(None).cast("int"), F.lit(1))) == 0


@pytest.mark.parametrize(("a", "b", "d"), [("0" * 16, "0" * 16, 0), ("0" * 16, "0" * 15 + "f", 4), ("0" * 16, "F" * 16, 64), ("0" * 16, "xyz", 64), ("0" * 16, None, 64)])
def test_hamming(spark, a, b, d):
    assert value(spark, M.hamming(M.halves_of_hex(F.lit(a)), M.halves_of_hex(F.lit(b).cast("string")))) == d


def test_luminance(spark):
    falling = F.array(*[F.lit(8 - i % 9) for i in range(72)])
    assert value(spark, M.hex_of(M.luminance_bits(falling))) == "f" * 16
    assert value(spark, M.luminance_bits(F.array(F.lit(1)))) is None


def test_max_distance():
    assert [M.max_distance(t) for t in (0.90, 0.85, 1.0, 0.8)] == [6, 9, 0, 12]


def test_half_even(spark):
    assert value(spark, F.bround(F.lit(0.8125), 3)) == 0.812


def test_fingerprint(spark):
    parts = lambda text: value(spark, M.fingerprint(F.lit(text).cast("binary"), F.lit(100), whole=10, part=4))
    a = "x" * 100
    assert value(spark, M.fingerprint(F.lit(a).cast("binary"), F.lit(100))) != parts(a)
    assert parts(a) == parts("x" * 10 + "y" + "x" * 89) != parts("y" + "x" * 99)  # only the first, middle and last parts count


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, cosine(a(1, 0), a(2, 0))) == 1 and value(spark, cosine(a(0, 0), a(1, 0))) == 0 and value(spark, cosine(a(1), a(1, 0))) == 0
    assert value(spark, cosine(F.lit(None).cast("array<float>"), a(1))) == 0


def test_blob(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(from_blob(to_blob("v"))).collect()] == [[1.5, -2.0], None]


@pytest.mark.parametrize(("raw", "want"), [
    ('["sunset"]', [("sunset", "general", 1.0)]), ('["scene:beach"]', [("beach", "scene", 1.0)]),
    ('[{"tag":"invoice","category":"documents","confidence":0.95}]', [("invoice", "documents", 0.95)]), ('[{"name":"x","confidence":"high"}]', [("x", "general", 1.0)]),
    ("a, b:c,,", [("a", "general", 1.0), ("c", "b", 1.0)]), ('[":x"]', [("x", "", 1.0)]), ("", []), (None, []), ("[]", []),
])
def test_tags(spark, raw, want):
    assert [tuple(t) for t in value(spark, X.parse_tags(F.lit(raw).cast("string")))] == want


def test_stored_tags(spark):
    assert [t.confidence for t in value(spark, X.stored_tags(X.parse_tags(F.lit('[{"tag":"A","confidence":0.5}, "a"]'))))] == [0.5]


@pytest.mark.parametrize(("raw", "ok"), [
    ('```json\n{"a": "b"}\n```', True), ('text {"a": "b"} more', True), ('{"a": "word word word word word word word', True), ('{"a": ["x", "y"', True), ("nothing", False), ("", False), (None, False)])
def test_repair(spark, raw, ok):
    got = value(spark, F.try_parse_json(X.repair_json(F.lit(raw).cast("string"))).isNotNull())
    assert got is ok


def test_repair_collapses_repeats(spark):
    assert value(spark, X.repair_json(F.lit('{"a": "go go go go go go go'))) == '{"a": "go"}'


@pytest.mark.parametrize(("before", "after"), [("", ""), ("```json\n", "\n```"), ("Here: ", " done")])
def test_repair_of_long_answers(spark, before, after):
    inner = '{"a": "' + "x y, " * 60_000 + '", "last": 1}'
    assert value(spark, X.repair_json(F.lit(before + inner + after))) == inner


def test_repair_of_long_cut_answers(spark):
    held = '{"a": "' + "x y, " * 60_000 + '", "b": "'
    assert value(spark, X.repair_json(F.lit(held + "go, " * 200_000 + "go"))) == held + 'go"}'


@pytest.mark.parametrize(("a", "b", "same"), [("en", "EN-us", True), ("en", "de", False), ("e", "en", False), (None, "en", False)])
def test_language(spark, a, b, same):
    assert value(spark, X.same_language(F.lit(a).cast("string"), F.lit(b))) is same


def test_template(spark):
    assert value(spark, X.fill_template(F.lit("{a}\n\n\n\nx"), {"a": F.lit("1"), "b": F.lit("2")})) == "1\n\nx\n\n2"


def test_people_lines_in_videos(spark):
    face = F.struct(F.lit("Ann").alias("name"), F.array(F.array(F.lit("00:01"), F.lit("00:03"))).alias("intervals"))
    assert value(spark, X.people_lines(F.array(face), video=True)) == "1. Ann at 00:01-00:03"


def test_module_status(spark):
    n = F.lit(None).cast("string")
    photo = value(spark, X.module_status(F.lit("photo"), n, F.lit("x"), n, F.lit("h"), F.lit("a"), n))
    assert tuple(photo) == (None, True, True, True)
    video = value(spark, X.module_status(F.lit("video"), F.lit("words"), n, F.lit("t"), n, F.lit("a"), F.lit("quota")))
    assert tuple(video) == (True, True, False, False)  # duplicates are known by a hash, for videos too
    assert value(spark, X.module_status(F.lit("video"), n, n, n, F.lit("h"), n, n))["duplicates"]


def test_luminance_bits_compute_a_grid_once(spark):
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: i * 37 % 11)
    want = "".join(str(int((r * 9 + c) * 37 % 11 > (r * 9 + c + 1) * 37 % 11)) for r in range(8) for c in range(8))
    got = spark.range(1).select(F.array_join(M.luminance_bits(grid).cast("array<string>"), "").alias("b"), M.luminance_bits(F.array(F.lit(1))).alias("none"))
    assert got.first()["b"] == want and got.first()["none"] is None
    text = M.luminance_bits(grid)._jc.toString()
    assert text.count("71") == 1, text
