"""The registered boosted trees train as many rounds as the operator's default."""

from meterflow.catalog import business
from meterflow.plans import learning


def test_boosted_metrics_train_the_default(monkeypatch):
    seen = []

    def train_and_evaluate(df, features, label, keys, ts, kind, **changes):
        seen.append((learning.BOOSTED | changes)["maxIter"])
        return None, df

    class Frame:
        columns = ()

        def filter(self, _):
            return self

    class T:
        hours = Frame()

    monkeypatch.setattr(business.learning, "train_and_evaluate", train_and_evaluate)
    monkeypatch.setattr(business.forecast, "training_features", lambda df: df)
    business.boosted_metrics(T())
    assert seen == [100]
