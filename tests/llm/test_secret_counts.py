"""The counts of op6_secrets by kind, against plain matches."""

import re

from matchlab.llm.secrets_query import op6_secrets

KINDS = {"n_assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
         "n_access": (r"AKIA[A-Z0-9]+", 0, 0, 20), "n_hex": (r"[0-9a-f]+", 0, 0, 24)}


def test_each_kind_is_counted_by_itself(spark, tmp_path):
    access, hexes = "AKIA" + "Q1" * 9, "deadbeef" * 4
    texts = [None, "", access, f"é {hexes}😀", f'Token = "{hexes}" {hexes}', f"PASSWD: abc123 {access} {access} {access}",
             f"{hexes} {hexes} {hexes} api_key=s3cret password:short", "secret=ab " + hexes[:23]]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        for name, (pattern, flags, group, least) in KINDS.items():
            assert got[i][name] == sum(len(m.group(group)) >= least for m in re.finditer(pattern, t or "", flags)), (i, name)
