"""Models of samples of many sizes against a reference, and sweeps that resume (API-01, API-02, API-10, CMP-08, CMP-09)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import latent, sampling

#: Takes a space (key, v) to a frame of the key and ``label``.
LabelFunction = Callable[[DataFrame], DataFrame]
#: ``trainer(sample, random_seed)`` gives the model, a function from rows to a space (key, v), and a dict of diagnostics.
Trainer = Callable[[DataFrame, int], tuple[object, Callable[[DataFrame], DataFrame], dict]]


def bundle(pairs: DataFrame, key: str) -> dict[str, float]:
    """CMP-07: all agreements of two paired spaces."""
    value = lambda df: df.first()[0]
    return {
        "procrustes": latent.procrustes(pairs), "linear_cka": latent.linear_cka(pairs), "gram_similarity": latent.gram_similarity(pairs),
        "jaccard_knn10": value(latent.knn_jaccard(pairs, key, 10)), "jaccard_knn30": value(latent.knn_jaccard(pairs, key, 30)),
        "trustworthiness": value(latent.trustworthiness(pairs, key, 10)), "continuity": value(latent.trustworthiness(pairs, key, 10, True)),
    }


def evaluate_subsamples(
    rows: DataFrame, held: DataFrame, sizes: Sequence[int], trainer: Trainer, key: str, seed: int = 42, labels: LabelFunction | None = None
) -> list[dict]:
    """CMP-08: a row per size, largest first: its model's space of ``held`` against that of the largest.

    Samples are nested. Without ``labels`` the agreement of labels (ari, nmi) is NaN."""
    spaces, notes = {}, {}
    for size in sorted(set(sizes), reverse=True):
        _, encode, notes[size] = trainer(sampling.exact_sample(rows, size, seed, key), seed)
        spaces[size] = encode(held)
    largest, out = max(spaces), []
    named = {n: labels(s).select(key, F.col("label").alias(f"_{n}")) for n, s in spaces.items()} if labels else {}
    for size, space in spaces.items():
        down = latent.collapse_diagnosis(space, d := latent.width(space)).first()
        ari = nmi = float("nan")
        if labels:
            both = named[largest].join(named[size].withColumnRenamed(f"_{size}", "_own"), key)
            ari, nmi = latent.label_agreement(both, f"_{largest}", "_own").first()
        out.append({
            "fraction": size / largest, "sample_rows": size, **bundle(latent.paired(spaces[largest], space, key), key), "latent_collapse": latent.collapse_score(space, d).first()[0],
            "active_percent": down["active_percent"], "ari": ari, "nmi": nmi, **notes[size],
        })
    return out


def run_name(parameters: dict) -> str:
    """The folder of a run, from which ``sweeps.params_of_path`` reads its parameters."""
    return "_".join(f"{k}_{v}" for k, v in parameters.items())


def _finished(place: Path, parameters: dict) -> dict | None:
    try:
        found = json.loads(place.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) and all(found.get(k) == v for k, v in parameters.items()) else None


def sweep(output: str, grid: Iterable[dict], run: Callable[[dict, str], dict], resume: bool = True, tell: Callable[[str], None] = lambda text: None) -> list[dict]:
    """API-10: ``run(parameters, folder)`` for each of ``grid``; results in ``folder/result.json`` and together in ``sweep_results.json``.

    A run whose result is whole and has the same parameters is not run again, so a sweep that
    was cut off goes on where it ended. Files appear under their names only when complete.
    ``output`` is a folder of the driver or a shared one."""
    results = []
    for parameters in grid:
        folder = Path(output, run_name(parameters))
        folder.mkdir(parents=True, exist_ok=True)
        found = _finished(folder / "result.json", parameters) if resume else None
        tell(f"{folder.name}: {'kept' if found else 'run'}")
        if found is None:
            found = {**parameters, **run(parameters, str(folder))}
            _write(folder / "result.json", found)
        results.append(found)
        _write(Path(output, "sweep_results.json"), results)
    return results


def _write(path: Path, data: object) -> None:
    part = path.with_suffix(".part")
    part.write_text(json.dumps(data, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(part, path)
