"""Running all audits that the given inputs allow, and reporting on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, confident, contracts, neighbors, structured, training

#: Audit -> inputs it needs, by task.
REQUIREMENTS = {
    "classification": {
        "null": ("features",), "label": ("label", "pred_probs"), "outlier": ("features",), "near_duplicate": ("features",), "non_iid": ("features",),
        "class_imbalance": ("label",), "underperforming_group": ("label", "pred_probs"), "data_valuation": ("label", "features"),
    },
    "regression": {"null": ("features",), "label": ("y", "prediction"), "outlier": ("features",), "near_duplicate": ("features",), "non_iid": ("features",)},
    "multilabel": {"null": ("features",), "label": ("bits", "probs"), "outlier": ("features",), "near_duplicate": ("features",), "non_iid": ("features",)},
}
#: Audits that can do with other inputs, in order of preference.
ALTERNATIVES = {"label": [("label", "features")], "outlier": [("label", "pred_probs")], "non_iid": [("pred_probs",)]}
#: Audits of the table as a whole, which flag no rows: inputs are columns of their own kinds.
TABLE_AUDITS = ("identifier_column", "spurious_correlations")
NOT_DEFAULT = {"data_valuation", *TABLE_AUDITS}
DESCRIPTIONS = {
    "null": "rows without any value in their features",
    "label": "labels that the predictions contradict",
    "outlier": "rows far from their neighbours, or with doubtful predictions",
    "near_duplicate": "rows very close to others",
    "non_iid": "an order of the rows that their features depend on",
    "class_imbalance": "rows of a class with too few of them",
    "underperforming_group": "rows of the group with the worst predictions",
    "data_valuation": "rows whose neighbours' labels they make worse",
    "identifier_column": "whole-number columns that only number the rows",
    "spurious_correlations": "properties that tell the label",
    "image_property": "rows with an odd property",
}
_CUSTOM: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def register(name: str, task: str = "classification", description: str = ""):
    """Add an audit: a function of the data that returns (id, score in [0, 1], is_<name>_issue)."""

    def add(f):
        _CUSTOM[task, name] = f
        if description:
            DESCRIPTIONS[name] = description
        return f

    return add


def possible_issue_types(task: str) -> list[str]:
    return sorted({*REQUIREMENTS[task], *TABLE_AUDITS, "image_property", *(n for t, n in _CUSTOM if t == task)})


def default_issue_types(task: str) -> list[str]:
    return [x for x in REQUIREMENTS[task] if x not in NOT_DEFAULT]


class Lab:
    """Audits of one table with an id column; inputs are its columns by name.

    A neighbour table (i, rank, j, d) that is there already is used as long as it has k neighbours
    of each row; its metric is taken on trust.  properties names columns of property scores with
    the threshold of each.
    """

    def __init__(self, data: DataFrame, task: str = "classification", k: int = 10, metric=None, edges: DataFrame | None = None, properties: dict[str, float] | None = None):
        if task not in REQUIREMENTS:
            raise ValueError(f"unknown task {task!r}: {sorted(REQUIREMENTS)}")
        self.data, self.task, self.k, self.metric, self.properties = data, task, k, metric, properties or {}
        self.issues = data.select("id")
        self.summary: dict[str, tuple[float, int]] = {}
        self.scores: dict[str, float] = {}
        self.failed: dict[str, str] = {}
        self.info: dict[str, dict] = {}
        self._extra: dict[str, DataFrame] = {}
        self._edges: dict[str, DataFrame] = {}
        if edges is not None and (edges.agg(F.max("rank")).first()[0] or 0) >= k:
            self._edges["features"] = edges.where(F.col("rank") <= k).persist()

    def __repr__(self) -> str:
        found = ", ".join(f"{n}: {c}" for n, (_, c) in sorted(self.summary.items())) or "no audit has run"
        return f"Lab(task={self.task!r}, k={self.k}, issues=({found}))"

    def statistics(self) -> dict:
        """Number of rows, and of classes where there are labels."""
        out = {"num_examples": self.data.count()}
        if self.task == "multilabel":
            return out | {"num_classes": self.data.agg(F.max(F.size("bits"))).first()[0]}
        if "label" in self.data.columns:
            out["num_classes"] = self.data.agg(F.count_distinct("label")).first()[0]
        return out

    def check(self) -> None:
        """Raise unless the inputs that are there keep their contracts."""
        cols, d = set(self.data.columns), self.data
        if {"label", "pred_probs"} <= cols:
            contracts.class_probabilities(d, confident.num_classes(d))
        if {"bits", "probs"} <= cols:
            contracts.multilabel(d, d.agg(F.max(F.size("bits"))).first()[0] or 0)
        if {"y", "prediction"} <= cols:
            contracts.regression(d)

    def available(self) -> list[str]:
        cols = set(self.data.columns)
        other = {"classification": ALTERNATIVES, "regression": {"label": [("y", "features")]}}.get(self.task, {})
        ways = lambda n, needs: [needs, *other.get(n, [])]
        found = [n for n, needs in REQUIREMENTS[self.task].items() if any(cols.issuperset(w) for w in ways(n, needs))]
        if not cols & {"cluster", "features"}:
            found = [n for n in found if n != "underperforming_group"]
        return found + [n for t, n in _CUSTOM if t == self.task]

    def edges(self, or_probs: bool = False) -> DataFrame:
        """The neighbour table over the features (or the probabilities, where an audit allows them), made once and shared by the audits."""
        source = "pred_probs" if or_probs and "features" not in self.data.columns else "features"
        if source not in self._edges:
            if source not in self.data.columns:
                raise ValueError("features are needed")
            self._edges[source] = neighbors.knn_edges(self.data.select("id", F.col(source).alias("features")), self.k, self.metric).persist()
        return self._edges[source]

    def _run(self, name: str, **kw) -> DataFrame:
        """(id, score, is_<name>_issue); a summary score other than the mean is left in self.scores."""
        d = self.data
        if (self.task, name) in _CUSTOM:
            return _CUSTOM[self.task, name](d, **kw)
        if name == "label":
            if self.task == "regression" and "prediction" not in d.columns:
                return training.RegressionLearning(**kw).find_label_issues(d.select("id", "y", "features")).withColumnRenamed("label_quality", "score")
            if self.task == "regression":
                return audits.regression_issues(d, **kw).withColumnRenamed("label_quality", "score")
            if self.task == "multilabel":
                return structured.multilabel_issues(d, **kw).join(structured.multilabel_quality(d).withColumnRenamed("label_quality", "score"), "id")
            if "pred_probs" in d.columns:
                p = d.select("id", "label", "pred_probs")
            else:
                p = neighbors.label_issue_probs(self.edges(), d.select("id", "label"), int(d.agg(F.max("label")).first()[0]) + 1)
            stats = confident.class_stats(p)
            joint = confident.confident_joint(p, stats=stats)
            self.scores[name] = confident.health_score(p, stats=stats)
            self.info[name] = {"thresholds": stats.thresholds, "joint": joint.tolist()}
            self._extra[name] = p.select("id", F.col("label").alias("given_label"), confident.A.argmax(F.col("pred_probs")).alias("predicted_label"))
            kw = {"min_examples_per_class": 10, "joint": joint, "stats": stats} | kw
            return confident.find_label_issues(p, **kw).join(confident.label_quality(p).withColumnRenamed("label_quality", "score"), "id")
        if name == "null":
            size = d.agg(F.max(F.size("features"))).first()[0] or 1
            full = F.size(F.filter("features", lambda x: x.isNotNull()))
            return d.select("id", F.coalesce(full / F.lit(float(size)), F.lit(0.0)).alias("score"), F.coalesce(full == 0, F.lit(True)).alias("is_null_issue"))
        if name == "outlier" and "features" not in d.columns:
            s = confident.ood_from_probs(d.select("id", "label", "pred_probs")).persist()
            limit = kw.get("threshold", 0.13) * s.agg(F.median("score")).first()[0]
            return s.withColumn("is_outlier_issue", F.col("score") < F.lit(limit))
        if name == "outlier":
            return neighbors.outliers(self.edges(), **kw)
        if name == "near_duplicate":
            found = neighbors.near_duplicates(self.edges(), **kw)
            self._extra[name] = found.select("id", F.col("nn_distance").alias("distance_to_nearest_neighbor")).join(neighbors.near_duplicate_sets(self.edges(), **kw), "id", "left")
            return found
        if name == "class_imbalance":
            got = audits.class_imbalance(d.select("id", "label"), **kw)
            self._extra[name] = d.select("id", F.col("label").alias("given_label"))
            rarest = d.groupBy("label").count().agg(F.min("count") / F.sum("count")).first()[0]
            self.scores[name] = rarest if rarest is not None else 1.0
            return got
        if name == "data_valuation":
            return neighbors.data_value(self.edges(), d.select("id", "label"), self.k, **kw)
        if name == "underperforming_group":
            if "cluster" not in d.columns:
                d = d.join(neighbors.density_clusters(self.edges(), d.select("id"), **kw.pop("clustering", {})), "id")
            worst = audits.underperforming_group(d, **kw).persist()
            lowest = worst.agg(F.min("ratio")).first()[0]
            if lowest is None:
                raise ValueError("no group has enough rows")
            self.scores[name] = lowest
            hit = F.coalesce("is_worst_issue", F.lit(False))
            return d.select("id", "cluster").join(worst, "cluster", "left").select("id", F.coalesce("ratio", F.lit(1.0)).alias("score"), hit.alias("is_underperforming_group_issue"))
        if name == "non_iid":
            n = d.count()
            _, p = neighbors.order_test(self.edges(or_probs=True), n)
            got = neighbors.order_scores(self.edges(or_probs=True), n).persist()
            worst = got.orderBy("score", "id").first() if p < kw.get("significance", 0.05) else None
            self.scores[name] = p
            return got.withColumn("is_non_iid_issue", F.col("id") == F.lit(worst["id"]) if worst else F.lit(False))
        raise ValueError(f"unknown audit {name!r}")

    def _table_audit(self, name: str, **kw) -> None:
        """Audits that flag columns, not rows: the score is the share of columns without an issue, or the least score of a property."""
        if name == "identifier_column":
            columns = kw.get("columns") or [c for c in self.data.columns if c not in ("id", "label")]
            found = [r["column"] for r in audits.identifier_columns(self.data.select(*columns)).where("is_identifier").orderBy("column").collect()]
            self.info[name] = {"identifier_columns": found}
            self.summary[name] = (1.0 - len(found) / max(1, len(columns)), len(found))
            return
        names = kw.get("properties") or sorted(self.properties)
        rows = self.data if "fold" in self.data.columns else training.folds(self.data, 5)
        scores = {r["property"]: r["score"] for r in audits.spurious_correlations(rows, list(names)).collect()}
        low = sorted(p for p, x in scores.items() if x < kw.get("threshold", 0.3))
        self.info[name] = {"scores": scores, "correlated_properties": low}
        self.summary[name] = (min(scores.values(), default=1.0), len(low))

    def find_issues(self, issue_types: dict[str, dict] | None = None) -> Lab:
        """Run the named audits, or the default ones that the columns allow; an audit that fails is listed and doesn't stop the others."""
        self.check()
        wanted = issue_types if issue_types is not None else {n: {} for n in self.available() if n not in NOT_DEFAULT}
        for name, kw in wanted.items():
            try:
                if name in TABLE_AUDITS:
                    self._table_audit(name, **kw)
                    continue
                if name == "image_property":
                    flags, common = audits.property_issues(self.data, self.properties, **kw)
                    kept = [p for p in self.properties if p not in common]
                    worst = F.least(*[F.col(p) for p in kept]) if len(kept) > 1 else F.col(kept[0]) if kept else F.lit(1.0)
                    some = F.lit(False)
                    for p in kept:
                        some = some | F.col(f"is_{p}_issue")
                    self.info[name], self._extra[name] = {"too_common": common}, flags
                    got = self.data.join(flags, "id").select("id", worst.alias("score"), some.alias("is_image_property_issue"))
                else:
                    got = self._run(name, **kw)
                flag = f"is_{name}_issue"
                got = got.withColumnsRenamed({"is_label_issue": flag}).select("id", F.col(flag), F.col("score").alias(f"{name}_score")).persist()
                score = F.col(f"{name}_score")
                mean, n, least, most = got.agg(F.avg(score), F.count_if(flag), F.min(score), F.max(score)).first()
                if least is not None and not (least >= -1e-9 and most <= 1 + 1e-9):
                    raise ValueError(f"scores of {name} must lie between 0 and 1, not {least} to {most}")
                self.summary[name] = (self.scores.pop(name, mean if mean is not None else 1.0), n)
                old = [c for c in (flag, f"{name}_score") if c in self.issues.columns]
                self.issues = self.issues.drop(*old).join(got, "id", "left")
            except Exception as e:  # noqa: BLE001
                self.failed[name] = str(e)
        return self

    def get_issues(self, name: str | None = None) -> DataFrame:
        """All flags and scores, or those of one audit with what it adds: given and predicted labels, distances and sets, single properties."""
        if name is None:
            return self.issues
        if f"is_{name}_issue" not in self.issues.columns:
            raise ValueError(f"no such issue: {name}")
        own = self.issues.select("id", f"is_{name}_issue", f"{name}_score")
        return own.join(self._extra[name], "id", "left") if name in self._extra else own

    def get_info(self, name: str | None = None) -> dict:
        return self.info if name is None else self.info.get(name, {})

    def get_issue_summary(self) -> DataFrame:
        rows = [(k, float(s), int(n)) for k, (s, n) in self.summary.items()]
        return self.data.sparkSession.createDataFrame(rows, "issue_type string, score double, num_issues bigint")

    def health_score(self) -> float:
        return sum(s for s, _ in self.summary.values()) / max(1, len(self.summary))

    def report(self, num_examples: int = 5, verbosity: int = 0, include_description: bool = False) -> str:
        """The audits with most issues first, each with its lowest rows; from verbosity 1 on also what it has found out besides."""
        lines = [f"{n} issues of {len(self.summary)} kinds" for n in [sum(n for _, n in self.summary.values())]]
        for name, (score, n) in sorted(self.summary.items(), key=lambda x: -x[1][1]):
            lines.append(f"\n{name}: {n} issues, score {score:.4f}")
            if include_description and name in DESCRIPTIONS:
                lines.append(f"  ({DESCRIPTIONS[name]})")
            if f"{name}_score" in self.issues.columns:
                worst = self.issues.select("id", f"{name}_score").orderBy(f"{name}_score", "id").limit(num_examples).collect()
                lines += [f"  id {r[0]}: {r[1]:.4f}" for r in worst if r[1] is not None]
            if verbosity > 0 or name in TABLE_AUDITS:
                lines += [f"  {k}: {v}" for k, v in self.info.get(name, {}).items()]
        lines += [f"failed: {k}: {v.splitlines()[0][:100]}" for k, v in self.failed.items()]
        return "\n".join(lines)
