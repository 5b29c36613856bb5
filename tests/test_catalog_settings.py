"""The registered model queries run at the full settings of the library."""

import pytest

from logtide.plans import catalog_features, catalog_scoring, experiment
from logtide.plans.experiment import FeatureSpace, Settings


class _Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("log_experiment_matrix", Settings()),
        ("session_experiment_matrix", Settings(group="sessions")),
        ("saved_bundle_scoring", Settings()),
    ],
)
def test_model_queries_train_every_configuration(monkeypatch, name, wanted):
    def asked(_, settings):
        raise _Asked(settings)

    monkeypatch.setattr(catalog_scoring, "_neutral_sessions", lambda *_: None)
    monkeypatch.setattr(experiment, "train_experiment", asked)
    with pytest.raises(_Asked) as found:
        getattr(catalog_scoring, name)(None, "")
    settings = found.value.args[0]
    assert settings == wanted
    assert len(settings.representations) * len(settings.classifiers) == 10


@pytest.mark.parametrize("name, size", [("log_word_embedding_features", 100), ("session_embedding_features", 64)])
def test_embedding_queries_return_vectors_of_full_size(spark, folder, monkeypatch, name, size):
    epochs, fit = [], FeatureSpace.fit
    monkeypatch.setattr(FeatureSpace, "fit", lambda train, settings: epochs.append(settings.epochs) or fit(train, settings))
    rows = getattr(catalog_features, name)(spark, folder).limit(20).collect()
    assert epochs == [5]
    assert rows and all(len(r["embedding"]) == len(r["weighted"]) == size for r in rows)
