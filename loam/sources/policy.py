"""Review policies: built-in values, a JSON file, and options, in this order."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

VERSIONS = ("0.1.0", "0.2.0")


class PolicyError(ValueError):
    """A policy that can't be used."""


@dataclass(frozen=True)
class Policy:
    """Thresholds, the least scores of the bands, exceptions (symbol id, approved maximum or None) and where they came from."""

    review_at: int = 11
    block_at: int | None = None
    bands: tuple[int, int, int] = (6, 11, 21)
    documentation_below: int | None = None
    exceptions: tuple[tuple[str, int | None], ...] = ()
    sources: tuple[str, ...] = field(default=("built-in",))

    def checked(self) -> Policy:
        if self.review_at < 1:
            raise PolicyError("the review threshold must be at least 1")
        if self.block_at is not None and self.block_at < self.review_at:
            raise PolicyError("the block threshold must not be under the review threshold")
        if not 2 <= self.bands[0] < self.bands[1] < self.bands[2]:
            raise PolicyError("bands must rise strictly from at least 2")
        if self.documentation_below is not None and not 1 <= self.documentation_below <= 100:
            raise PolicyError("a documentation percentage lies between 1 and 100")
        return self

    @property
    def named_bands(self) -> tuple[tuple[str, int], ...]:
        return (("low", 0), *zip(("moderate", "high", "critical"), self.bands))


def from_json(text: str, base: Policy = Policy()) -> Policy:
    """``base`` with a file's values; unknown keys and versions are errors."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise PolicyError(f"not JSON: {e}") from None
    _known(raw, {"policy_version", "cyclomatic_complexity", "documentation_coverage"}, "policy")
    if raw.get("policy_version") not in VERSIONS:
        raise PolicyError(f"policy_version {raw.get('policy_version')!r} is not one of {', '.join(VERSIONS)}")
    part, doc = raw.get("cyclomatic_complexity") or {}, raw.get("documentation_coverage") or {}
    _known(part, {"human_review_at", "block_at", "risk_bands", "exceptions"}, "cyclomatic_complexity")
    _known(doc, {"human_review_below"}, "documentation_coverage")
    bands = part.get("risk_bands") or {}
    _known(bands, {"moderate_at", "high_at", "critical_at"}, "risk_bands")
    exceptions = []
    for e in part.get("exceptions") or []:
        _known(e, {"symbol_id", "reason", "approved_max", "unbounded"}, "exception")
        if not str(e.get("reason") or "").strip():
            raise PolicyError("an exception needs a reason")
        if ("approved_max" in e) == bool(e.get("unbounded")):
            raise PolicyError("an exception needs either approved_max or unbounded")
        exceptions.append((e["symbol_id"], e.get("approved_max")))
    return replace(
        base,
        review_at=part.get("human_review_at", base.review_at),
        block_at=part.get("block_at", base.block_at),
        bands=tuple(bands.get(k, b) for k, b in zip(("moderate_at", "high_at", "critical_at"), base.bands)),
        documentation_below=doc.get("human_review_below", base.documentation_below),
        exceptions=tuple(exceptions) or base.exceptions,
        sources=(*base.sources, "policy-file"),
    ).checked()


def with_options(base: Policy, review_at: int | None = None, block_at: int | None = None, no_block: bool = False, documentation_below: int | None = None) -> Policy:
    given = {k: v for k, v in {"review_at": review_at, "block_at": block_at, "documentation_below": documentation_below}.items() if v is not None}
    if no_block:
        given["block_at"] = None
    return replace(base, **given, sources=(*base.sources, "cli")).checked() if given else base.checked()


def _known(raw: object, keys: set[str], where: str) -> None:
    if not isinstance(raw, dict):
        raise PolicyError(f"{where} must be an object")
    if extra := sorted(set(raw) - keys):
        raise PolicyError(f"{where} has unknown keys: {', '.join(extra)}")
