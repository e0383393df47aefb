"""Ids of words by way of their units."""

from ballast.llm import vector_packing as V


def test_units_outlive_the_words(monkeypatch):
    """Where a task starts its words anew, units it knows are not merged again; the ids stay the same."""
    merged = []

    def merge(unit):
        merged.append(unit)
        return [ord(c) for c in unit]

    monkeypatch.setattr(V, "REMEMBERED", 3)
    ids = V.WordIds(lambda text: [ord(c) for c in text.lower()], merge)
    texts = ["One two", "one TWO it's a1", "two one"]
    for text in texts * 3:
        got = ids.batch([text])[0].tolist()
        assert got == [ord(c) for word in text.split() for c in word.lower()]
        assert len(ids.units) <= 3 + 8
    merged.clear()
    ids.units.clear()
    for _ in range(5):
        ids.batch(["one two"])
        ids.clear()
    assert sorted(merged) == ["one", "two"]
