"""rounds of the attachment merge carry numbers only; the result is that of the plain fold."""

from __future__ import annotations

import random
from pathlib import Path


def test_f9_rounds_carry_numbers_and_match_the_plain_fold(spark):
    from tidemark.lineage import folder
    from tidemark.operators.attachments import merge_candidates

    rng = random.Random(5)
    made = [[(rng.choice([None, 1, 2, 3]), k, rng.choice([None, "", "u1", "u2", "u3", "u4"]), rng.choice([None, "", "A", "a", "b", "C"]), rng.choice([None, "", "x", "y"])) for k in range(60)] for _ in range(2)]
    first, second = (spark.createDataFrame(rows, "group_id long, at long, url string, filename string, kind string") for rows in made)
    room = Path(folder(spark).removeprefix("file://"))
    before = set(room.glob("attachments-*"))
    got = sorted(map(repr, (tuple(r) for r in merge_candidates(first, second, ["url", "filename", "kind"], ["at"]).select("group_id", "url", "filename", "kind").collect())))
    want = []
    for group in (None, 1, 2, 3):
        listed = []
        for _, _, url, name, kind in [r for rows in made for r in rows if r[0] == group]:
            hit = next((x for x in listed if url and x["u"] == url), None) or next((x for x in listed if name and x["n"] == name.lower()), None)
            if hit is None:
                listed.append({"u": url or None, "n": (name or "").lower() or None, "v": [url, name, kind]})
            else:
                hit["v"] = [old if old else new if new else old for old, new in zip(hit["v"], (url, name, kind))]
        want += [(group, *x["v"]) for x in listed]
    assert got == sorted(map(repr, want))
    written = [spark.read.parquet(f"file://{p}").columns for p in set(room.glob("attachments-*")) - before]
    assert len(written) > 2 and all(c == ["_i", "_u", "_f", "_at", "_into"] for c in written if "_u" in c) and not any("_place" in c for c in written)
