"""The class of a document hangs on the profiles, and on each of the distributions they state."""

import numpy as np
import pytest

from tests.conftest import DATA
from verbatrix.llm import text_quality
from verbatrix.llm.text_quality import Shape, divergence, function_shares, nearest


@pytest.fixture(scope="module")
def shapes(duck):
    rows = duck.execute(f"SELECT text FROM '{DATA}/sf0.01/documents.parquet' WHERE trim(text) <> '' ORDER BY doc_id").fetchall()
    return [Shape(t) for (t,) in rows if t.strip()]


def classes(shapes):
    return np.array([x[0] for x in nearest(shapes)])


def test_exchanged_profiles_change_classes(shapes, monkeypatch):
    before = classes(shapes)
    turned = tuple(np.roll(table, 9, axis=0) for table in text_quality._BY_KIND)
    monkeypatch.setattr(text_quality, "_BY_KIND", turned)
    assert (classes(shapes) != before).mean() > 0.5


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_no_distribution_decides_alone(shapes, monkeypatch, kind):
    before = classes(shapes)
    monkeypatch.setattr(text_quality, "WEIGHTS", tuple(w if i == kind else 0.0 for i, w in enumerate(text_quality.WEIGHTS)))
    assert (classes(shapes) != before).any()


def test_function_words_by_language():
    text = "La redacción de la ciudad no quita los textos que ha publicado, y se lo dice a todos los que lo piden por su caso."
    shape = Shape(text)
    assert shape.language == "es" and sum(shape.function) == pytest.approx(1)
    right, wrong = (divergence(shape.function, function_shares("es", x)) for x in (0.33, 0.0))
    assert right < wrong
    assert [Shape(x).language for x in ("Der Rat und die Stadt haben es so nicht mit uns gewollt.", "Le conseil de la ville ne veut pas de ce texte.", "The council of the town would not have it.")] == ["de", "fr", "en"]
