"""Reports and client code for a trained project."""

from __future__ import annotations

import json
from datetime import datetime, timezone


def summary(runs: list[dict], task: str) -> dict:
    """The best run, how many there are, and the three best; missing scores count as 999 (rmse) or 0 (accuracy)."""
    score = (lambda r: -(r.get("metrics") or {}).get("rmse", 999)) if task == "regression" else (lambda r: (r.get("metrics") or {}).get("accuracy", 0))
    ranked = sorted(runs, key=lambda r: -score(r))
    return {"best": ranked[0] if ranked else None, "total": len(runs), "top": ranked[:3]}


def report(project: dict, dataset: dict, runs: list[dict], task: str) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    about = {k: dataset.get(k) for k in ("name", "rows", "columns", "column_types", "target_column")}
    return json.dumps({"project": project, "dataset": about, "runs": runs, "summary": summary(runs, task), "generated_at": stamp}, default=str)


def client_code(language: str, model_path: str, features: list[str], url: str = "http://localhost/predict") -> str:
    """A snippet that scores one row: python (this package), curl or php (a service at url)."""
    body = json.dumps({"features": {f: 0 for f in features}})
    if language == "python":
        return (
            "from lattice.operators import tuning\nfrom lattice.session import session\nfrom lattice.sources.tables import from_rows\n\n"
            f"spark = session('score')\npipeline = tuning.load(spark, {model_path!r})\nrows = from_rows(spark, [{{{', '.join(f'{f!r}: 0' for f in features)}}}])\n"
            "tuning.predict_rows(pipeline, rows).show()\n"
        )
    if language == "curl":
        return f"curl -X POST {url} -H 'Content-Type: application/json' -d '{body}'\n"
    if language == "php":
        return f"<?php\n$request = curl_init('{url}');\ncurl_setopt($request, CURLOPT_POSTFIELDS, '{body}');\ncurl_setopt($request, CURLOPT_HTTPHEADER, ['Content-Type: application/json']);\ncurl_setopt($request, CURLOPT_RETURNTRANSFER, true);\necho curl_exec($request);\n"
    raise ValueError(f"no client code for {language}")
