import json
import random

import pytest

from headway.sources import osm


def document(n, seed, **layout):
    r = random.Random(seed)
    odd = ["Elm", 'a "quoted" name', "back\\slash\\", "braces } { ] [", '\\"}{', "é}日", ""]
    out = []
    for i in range(n):
        tags = {"name": r.choice(odd), "type": "route", "addr:housenumber": str(i), "addr:street": r.choice(["Oak St", "Elm }"])}
        e = {"type": r.choice(["node", "way"]), "id": i, "tags": tags}
        if e["type"] == "way":
            e["center"] = {"lat": 41.8, "lon": -87.7}
            e["geometry"] = [{"lat": 41.0 + k, "lon": -87.0} for k in range(r.randrange(0, 4))]
        else:
            e |= {"lat": 41.9, "lon": -87.6}
        out.append(e)
    return json.dumps({"version": 0.6, "osm3s": {"copyright": "x } {"}, "elements": out}, ensure_ascii=False, **layout)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}])
def test_blocks_equal_the_whole_read(spark, tmp_path, layout):
    (tmp_path / "a.json").write_text(document(90, 1, **layout), encoding="utf-8")
    (tmp_path / "b.json").write_text(document(3, 2, **layout), encoding="utf-8")
    (tmp_path / "c.json").write_text(document(0, 3, **layout), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        path = str(tmp_path)
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
        want, got = osm.read_elements(spark, path), osm.read_divided(spark, path)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert osm.read_osm(spark, path, "ways", divided=True).columns == ["way_id", "name", "geometry"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
