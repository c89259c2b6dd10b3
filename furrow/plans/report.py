"""The text and HTML report, from small result tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Row, SparkSession

from furrow.plans.views import last_metrics, overview
from furrow.sources.files import report_inputs


def _fmt(x, digits: int = 3) -> str:
    return "N/A" if x is None or x != x else f"{x:,.{digits}f}"


def _lines(df: DataFrame, columns: list[str]) -> list[str]:
    rows = [[str(r[c]) if isinstance(r[c], (int, str)) else _fmt(r[c], 6) for c in columns] for r in df.collect()]  # a few rows
    width = [max(len(c), *(len(r[i]) for r in rows), 1) for i, c in enumerate(columns)] if rows else [len(c) for c in columns]
    return [" ".join(v.rjust(w) for v, w in zip(line, width)) for line in [columns, *rows]]


def of_files(spark: SparkSession, out: str) -> str:
    """The report of a finished run, from the files that are there."""
    found = report_inputs(spark, out)
    return summary(found["panel"], found["metrics_summary"], found["backtest_by_year"], found["timing_summary"])


def summary(panel: DataFrame | None, metrics: DataFrame | None, by_year: DataFrame | None, timing: DataFrame | None = None, written: list[str] = []) -> str:
    """What a table that is None would show is N/A, or left out."""
    o = overview(panel).first() if panel is not None else Row(n_rows=0, n_regions=0, n_crops=0, first_year="N/A", last_year="N/A")
    rows = {r.model: r.asDict() for r in metrics.collect()} if metrics is not None else {}  # a row a model
    get = lambda model, name: rows.get(model, {}).get(name)
    out = ["Panel analytics summary", "", "Dataset:", f"- Rows: {o.n_rows:,}", f"- Regions: {o.n_regions}", f"- Crops: {o.n_crops}", f"- Years: {o.first_year} to {o.last_year}"]
    parts = (
        ("Baselines", "Baseline", (("Classifier macro-F1", "baseline_clf_macro_f1"), ("Regressor RMSE", "baseline_reg_rmse"), ("Regressor R2", "baseline_reg_r2"))),
        ("Best classifier", "BestClassifier", (("Model", "best_model_name"), ("OOF macro-F1", "oof_f1_macro"), ("OOF accuracy", "oof_accuracy"), ("Train macro-F1", "train_f1_macro"))),
        ("Best regressor", "BestRegressor", (("Model", "best_model_name"), ("OOF RMSE", "oof_rmse"), ("OOF R2", "oof_r2"))),
        ("Backtest (walk-forward)", "Backtest", (("RMSE", "rmse"), ("MAE", "mae"), ("MAPE (%)", "mape"), ("R2", "r2"), ("Rows", "n"))),
    )
    for title, model, names in parts:
        values = [(label, get(model, name)) for label, name in names]
        out += ["", f"{title}:", *(f"- {label}: {v if isinstance(v, str) else _fmt(v)}" for label, v in values)]
    if by_year is not None:
        out += ["", "Backtest metrics of the last years:", *_lines(last_metrics(by_year), ["year", "rmse", "mae", "mape", "r2", "n"])]
    if timing is not None:
        out += ["", "Seconds by stage:", *_lines(timing, ["stage", "seconds"])]
    if written:
        out += ["", "Outputs written:", *(f"- {w}" for w in written)]
    return "\n".join(out) + "\n"


def as_html(text: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Summary</title></head><body><pre>{html.escape(text, quote=False)}</pre></body></html>"
