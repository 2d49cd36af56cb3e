"""The names of resolved_entities against plain Python."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph.functions import names
from quillgraph.plans.registry import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_resolved_entities_reads_all_names(spark):
    nations = {r["n_nationkey"]: r["n_name"] for r in table(spark, SF, "nation").collect()}
    told = lambda n: f"{n} {hashlib.sha256(n.encode()).hexdigest()[:8]}"
    forms = []
    for r in table(spark, SF, "supplier").collect():
        forms += [(x, "ORG") for n in [told(r["s_name"])] for x in (n, n.replace("#", " "), n + ", Inc.")]
    for r in table(spark, SF, "customer").collect():
        n = told(r["c_name"])
        plain = n.replace("#", " ")
        forms += [(x, "PERSON") for x in (n, "Dr. " + plain, f"{plain} of {nations[r['c_nationkey']]}", n[:-1])]
    keys = [(set(names.lookup_keys(n, names.bucket(t))), set(names.index_keys(n, names.bucket(t)))) for n, t in forms]
    root = list(range(len(forms)))
    for i, (a, ta) in enumerate(forms):
        for j, (b, tb) in enumerate(forms):
            if i != j and root[i] != root[j] and keys[i][0] & keys[j][1] and names.match(a, ta, b, tb)[0]:
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    want = sorted(root.count(v) for v in set(root))
    got = entry.queries()["resolved_entities"](spark, SF)
    assert sorted(r["forms"] for r in got.collect()) == want and len(want) > 25 and got.agg(F.sum("forms")).first()[0] == len(set(forms))
