"""Chain models: validation, TOML and row form.

Variants: ``HMC-IN`` and ``HMC-IN2`` (independent noise), ``HMC-DN`` (copula between
consecutive observations), ``PMC-IN`` and ``PMC`` (pairwise chains, with state or pair
margins).  Hidden chains are given by a transition matrix ``A``, pairwise ones by a
joint matrix ``p``.
"""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions.copulas import FAMILIES, Family
from ..functions.margins import Margin

VARIANTS = ("HMC-IN", "HMC-IN2", "HMC-DN", "PMC-IN", "PMC")


class ModelError(ValueError):
    """A model that is not valid."""


@dataclass(frozen=True)
class Copula:
    name: str = "Prod"
    tau: float = 0.0
    extras: dict[str, float] = field(default_factory=dict)

    @property
    def family(self) -> Family:
        return FAMILIES[self.name]

    @property
    def params(self) -> dict[str, float]:
        return self.family.params(self.tau, self.extras)


@dataclass(frozen=True)
class VectorMargin:
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Missingness:
    """``state``: a row is missing with ``rates[i]``.  ``state_markov``: missing starts
    with ``onset[i]`` and lasts with ``persistence[i]``."""

    mechanism: str
    rates: tuple[float, ...] = ()
    onset: tuple[float, ...] = ()
    persistence: tuple[float, ...] = ()

    def log_evidence(self, miss: np.ndarray) -> np.ndarray:
        """``(N, K)`` log probabilities of the mask given the state."""
        m = np.asarray(miss, bool)
        if self.mechanism == "state":
            p = np.tile(np.array(self.rates), (len(m), 1))
        else:
            a, b = np.array(self.onset), np.array(self.persistence)
            p = np.where(np.concatenate([[False], m[:-1]])[:, None], b[None], a[None])
            p[0] = self.stationary()
        return np.log(np.clip(np.where(m[:, None], p, 1 - p), 1e-300, None))

    def stationary(self) -> np.ndarray:
        a, b = np.array(self.onset), np.array(self.persistence)
        return a / (1 - b + a)


def stationary(A: np.ndarray) -> np.ndarray:
    """Stationary law of a transition matrix: power iteration, then least squares."""
    pi = np.full(len(A), 1 / len(A))
    for _ in range(1000):
        new = pi @ A
        if np.abs(new - pi).max() < 1e-12:
            return new / new.sum()
        pi = new
    K = len(A)
    lhs = np.vstack([A.T - np.eye(K), np.ones(K)])
    return np.linalg.lstsq(lhs, np.concatenate([np.zeros(K), [1.0]]), rcond=None)[0]


@dataclass(frozen=True)
class Model:
    variant: str
    p: np.ndarray
    margins: dict[tuple[int, ...], Margin | VectorMargin]
    copulas: dict[tuple[int, int], Copula] = field(default_factory=dict)
    name: str = "model"
    n_default: int = 1000
    missingness: Missingness | None = None
    candidates: dict[tuple[int, ...], tuple[str, ...]] = field(default_factory=dict)
    estimation: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.variant not in VARIANTS:
            raise ModelError(f"unknown variant {self.variant!r}")
        K = len(self.p)
        if K < 2 or self.p.shape != (K, K) or (self.p < 0).any() or abs(self.p.sum() - 1) > 1e-6:
            raise ModelError("p must be a K x K joint law with K >= 2")
        keys = {(i,) for i in range(K)} if not self.is_pair else {(i, j) for i in range(K) for j in range(K)}
        if set(self.margins) != keys:
            raise ModelError(f"margins must be given for {sorted(keys)}")
        if self.is_pair and not self.variant.startswith("PMC"):
            raise ModelError("pair margins need a pairwise variant")
        if self.d > 1 and self.uses_copula:
            raise ModelError("vector observations do not combine with copulas")

    @property
    def K(self) -> int:
        return len(self.p)

    @property
    def pi(self) -> np.ndarray:
        return self.p.sum(axis=1)

    @property
    def A(self) -> np.ndarray:
        return self.p / self.pi[:, None]

    @property
    def is_pair(self) -> bool:
        return len(next(iter(self.margins))) == 2

    @property
    def uses_copula(self) -> bool:
        return self.variant in ("HMC-DN", "PMC")

    @property
    def d(self) -> int:
        first = next(iter(self.margins.values()))
        return len(first.mean) if isinstance(first, VectorMargin) else 1

    @property
    def needs_grid(self) -> bool:
        """Whether a missing observation must be integrated on a grid."""
        return self.uses_copula or self.is_pair

    def margin(self, i: int, j: int) -> Margin | VectorMargin:
        return self.margins[(i, j)] if self.is_pair else self.margins[(i,)]

    def copula(self, i: int, j: int) -> Copula:
        return self.copulas.get((i, j), Copula())

    def with_missingness(self, missingness: Missingness | None) -> Model:
        return replace(self, missingness=missingness)

    # ------------------------------------------------------------------ TOML

    @classmethod
    def from_dict(cls, raw: dict) -> Model:
        head, prior = raw["model"], raw["prior"]
        if ("A" in prior) == ("p" in prior):
            raise ModelError("give either A or p")
        if "A" in prior:
            A = np.array(prior["A"], float)
            if np.abs(A.sum(axis=1) - 1).max() > 1e-6:
                raise ModelError("rows of A must sum to 1")
            p = stationary(A)[:, None] * A
        else:
            p = np.array(prior["p"], float)
        if head.get("K", len(p)) != len(p):
            raise ModelError("K does not match the prior")
        margins, candidates = {}, {}
        for m in raw["margins"]:
            key = (m["i"], m["j"]) if "j" in m else (m["i"],)
            q = m.get("params", {})
            if m["dist"] == "multivariate_normal":
                margins[key] = VectorMargin(tuple(map(float, q["mean"])), tuple(tuple(map(float, r)) for r in q["cov"]))
            else:
                margins[key] = Margin(m["dist"], {k: float(v) for k, v in q.items()})
            if m.get("candidates"):
                candidates[key] = tuple(m["candidates"])
        copulas = {}
        for c in raw.get("copulas", []):
            extras = {k: float(v) for k, v in c.items() if k not in ("i", "j", "name", "tau", "tau_k")}
            copulas[(c["i"], c["j"])] = Copula(c["name"], float(c.get("tau", c.get("tau_k", 0.0))), extras)
        miss = None
        if raw.get("missingness"):
            t = raw["missingness"]
            miss = Missingness(t["mechanism"], tuple(t.get("rates", ())), tuple(t.get("onset", ())), tuple(t.get("persistence", ())))
        return cls(head["variant"], p, margins, copulas, head.get("name", "model"), head.get("N_default", 1000), miss, candidates, {k: raw[k] for k in ("ice", "sem") if k in raw})

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.from_dict(tomllib.load(f))

    def to_dict(self) -> dict:
        raw: dict = {"model": {"name": self.name, "variant": self.variant, "K": self.K, "d": self.d, "N_default": self.n_default}}
        raw["prior"] = {"p": self.p.tolist()} if self.variant.startswith("PMC") else {"A": self.A.tolist()}
        raw["margins"] = []
        for key, m in sorted(self.margins.items()):
            block = dict(zip("ij", key, strict=False))
            if isinstance(m, VectorMargin):
                block |= {"dist": "multivariate_normal", "params": {"mean": list(m.mean), "cov": [list(r) for r in m.cov]}}
            else:
                block |= {"dist": m.dist, "params": dict(m.params)}
            if key in self.candidates:
                block["candidates"] = list(self.candidates[key])
            raw["margins"].append(block)
        raw["copulas"] = [{"i": i, "j": j, "name": c.name, "tau": c.tau, **c.extras} for (i, j), c in sorted(self.copulas.items())]
        if self.missingness:
            m = self.missingness
            raw["missingness"] = {"mechanism": m.mechanism} | {k: list(v) for k, v in (("rates", m.rates), ("onset", m.onset), ("persistence", m.persistence)) if v}
        return raw | self.estimation

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(to_toml(self.to_dict()))


def to_toml(raw: dict) -> str:
    """TOML text of tables and arrays of tables of plain values."""

    def value(x) -> str:
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, str):
            return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(x, int):
            return str(x)
        if isinstance(x, float):
            return repr(x) if math.isfinite(x) else ("nan" if math.isnan(x) else ("inf" if x > 0 else "-inf"))
        if isinstance(x, dict):
            return "{" + ", ".join(f"{k} = {value(v)}" for k, v in x.items()) + "}"
        return "[" + ", ".join(value(v) for v in x) + "]"

    out = []
    for name, table in raw.items():
        for header, rows in ((f"[[{name}]]", table),) if isinstance(table, list) else ((f"[{name}]", [table]),):
            for row in rows:
                out.append(header)
                out += [f"{k} = {value(v)}" for k, v in row.items()]
                out.append("")
    return "\n".join(out)


def gaussian(variant: str, means, sds, stay: float = 0.9, tau: float = 0.0, family: str = "Gauss") -> Model:
    """A K-state model with normal margins and one diagonal copula, for examples."""
    K = len(means)
    A = np.full((K, K), (1 - stay) / (K - 1))
    np.fill_diagonal(A, stay)
    p = stationary(A)[:, None] * A
    copulas = {(i, j): Copula(family, tau) if i == j and tau else Copula() for i in range(K) for j in range(K)} if variant in ("HMC-DN", "PMC") else {}
    return Model(variant, p, {(i,): Margin("norm", {"loc": float(m), "scale": float(s)}) for i, (m, s) in enumerate(zip(means, sds, strict=True))}, copulas)
