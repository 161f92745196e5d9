"""The registered digest against a brute-force digest of the same rows."""

import hashlib

from pyspark.sql import functions as F

from loomdoc.plans import catalogue


def test_digest_of_lineitem(spark):
    at = "/root/testdata/sf0.001"
    rows = catalogue.table(spark, at, "lineitem")
    lanes, n = [0] * 5, 0
    for r in rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("j")).collect():
        h, n = hashlib.sha256(r.j.encode()).hexdigest(), n + 1
        lanes = [x + int(h[12 * i : 12 * i + 12], 16) for i, x in enumerate(lanes)]
    want = hashlib.sha256(":".join(map(str, [n, *lanes])).encode()).hexdigest()
    got = catalogue.QUERIES["digest_lineitem"](spark, at).first()
    assert (got.status, got.documents, got.digest) == ("OK", n, want)
