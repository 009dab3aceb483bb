from pointloom import queries
from pointloom.operators import attributes


def test_query_fits_with_default_seeds(monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def preclassify(points, **params):
        seen.update(params)
        raise Stop

    monkeypatch.setattr(attributes, "normalise", lambda points: points)
    monkeypatch.setattr(queries.A, "points", lambda spark, sf_dir: None)
    monkeypatch.setattr(attributes, "preclassify", preclassify)
    try:
        queries.kmeans_materials(None, "")
    except Stop:
        pass
    assert seen == {}
