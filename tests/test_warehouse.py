"""Loading of the feature, place, coordinate and event files as frames."""

import pytest

from trailmark.sources import io


def stored(tmp_path, **texts):
    out = {}
    for name, text in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        out[name] = str(path)
    return out


FEATURES = """user_key,location_id,location_name,location_category_name,primary_category,total_interaction_score,last_interaction_time,extra
 u1 ,A,Alpha,Art; Food,Art,1.5,2024-01-01 00:00:00,x
u1,A,Alpha,Art; Food,Art,2.5,2024-01-02 00:00:00,y
u2,A,Alpha,Food;Parks,,oops,,z
u2,B,Beta,,Zoo,3,2024-01-03 00:00:00,
,B,Beta,,Zoo,3,2024-01-03 00:00:00,
u3,,Gamma,,Zoo,3,2024-01-03 00:00:00,
"""


def test_frames(spark, tmp_path):
    at = stored(tmp_path, features=FEATURES, dim="location_id,location_name\nA,Official A\n C ,Gamma\nC,Gamma\n,None\n", geo="location_id,lat,lon\nA,41.9,-87.6\nA,41.8,-87.7\nC,far,-87\n", events="event_id,event_time\n1,2024-01-01 10:00:00\n2,never\n")
    w = io.load_warehouse(spark, **at)
    pairs = {(r["user_key"], r["location_id"]): r["total_interaction_score"] for r in w.interactions.collect()}
    assert pairs == {("u1", "A"): 2.5, ("u2", "A"): None, ("u2", "B"): 3.0}
    places = {r["location_id"]: (r["location_name"], r["categories"], r["observed"], r["lat"], r["lon"], r["popularity_norm"]) for r in w.locations.collect()}
    assert places == {"A": ("Official A", ["Art", "Food", "Parks"], True, 41.8, -87.7, 0.0), "C": ("Gamma", [], False, None, None, 0.0)}
    assert sorted(r["user_key"] for r in w.users.collect()) == ["u1", "u2"]
    assert [r["event_id"] for r in w.events.collect()] == ["1"]
    assert [r["category"] for r in w.categories().collect()] == ["Art", "Food", "Parks"]
    assert w.observed_counts().first().asDict() == {"n_official": 2, "n_observed": 1}


def test_what_may_be_absent(spark, tmp_path):
    at = stored(tmp_path, features="user_key,location_id,location_name\nu,A,Alpha\n", bad="user_key,location_name\nu,Alpha\n")
    w = io.load_warehouse(spark, at["features"])
    assert w.events is None and w.locations.first()["observed"] and w.users.count() == 1
    with pytest.warns(UserWarning, match="events not found"):
        assert io.load_warehouse(spark, at["features"], events=str(tmp_path / "none.csv")).events is None
    with pytest.raises(ValueError, match="location_id"):
        io.load_warehouse(spark, at["bad"])
    with pytest.raises(ValueError, match="dim lacks location_id"):
        io.load_warehouse(spark, at["features"], dim=at["bad"])
    empty = stored(tmp_path, features="user_key,location_id,location_name\n")
    assert io.load_warehouse(spark, empty["features"]).locations.count() == 0
