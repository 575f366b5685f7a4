import pytest
from pyspark.sql import functions as F

from tessera import project
from tessera.functions import secrets
from tessera.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("value, slug", [("git@host:user/repo.git", "user-repo"), ("https://host/user/repo.git", "user-repo"), ("/abs/path/to/my project", "to-my_project"), ("single", "single")])
def test_slug(spark, value, slug):
    assert one(spark, T.slug_base(F.col("x")), x=value) == slug
    assert one(spark, T.slug(F.col("x")), x=value) == project.slug(value)


@pytest.mark.parametrize("path, ext, tail, language", [("a/b.py", ".py", ".py", "python"), ("a/.bashrc", "", ".bashrc", None), ("Makefile", "", "e", None), ("x.tar.gz", ".gz", ".gz", None), ("q.tsx", ".tsx", ".tsx", "tsx")])
def test_extensions(spark, path, ext, tail, language):
    got = spark.createDataFrame([(path,)], "x string").select(T.extension(F.col("x")), T.after_last_dot(F.col("x")), T.language(F.col("x"))).first()
    assert tuple(got) == (ext, tail, language)


def test_lengths(spark):
    assert one(spark, T.utf16_length(F.col("x")), x="a😀b") == 4
    assert one(spark, T.token_estimate(F.col("x")), x="12345") == 2
    assert one(spark, T.duration_ms(F.col("x")), x="10m") == 600_000
    with pytest.raises(Exception, match="Invalid duration"):
        one(spark, T.duration_ms(F.col("x")), x="10 weeks")


def test_header_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([("a.py", "definition", None, "x"), ("a.py", "definition", "class A > def b", None)], "p string, r string, s string, d string")
    got = [r[0] for r in df.select(T.context_header(F.col("p"), F.col("r"), F.col("s"), F.col("d"))).collect()]
    assert got == ["[file: a.py]\n[role: definition]\n[doc: x]", "[file: a.py]\n[role: definition]\n[scope: class A > def b]"]


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "x array<float>, y array<float>")
    assert tuple(df.select(*(T.distance(F.col("x"), F.col("y"), m) for m in ("l2", "cosine", "dot"))).first()) == (5.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        T.distance(F.col("x"), F.col("y"), "other")


def test_share_codes(spark):
    code = secrets.share_code()
    assert one(spark, secrets.is_share_code(F.col("x")), x=code)
    assert not one(spark, secrets.is_share_code(F.col("x")), x="tesseraX123")
    assert secrets.topic(code) != secrets.key(code)


def test_hkdf_vector():
    import hashlib
    import hmac

    prk = hmac.digest(b"salt", b"secret", hashlib.sha256)
    assert secrets.hkdf("secret", "salt", "info") == hmac.digest(prk, b"info\x01", hashlib.sha256)
