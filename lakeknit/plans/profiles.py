"""Settings of a linkage run. Later generations of rules are the default; earlier ones differ in these values only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Sibling:
    """When a likely target of one source (from ``high``, none: the threshold) raises a doubtful one (from ``low``) of the other, by ``gain`` over the threshold."""

    agree: str
    high: float | None
    low: float
    gain: float


@dataclass(frozen=True)
class Profile:
    """Channels and their weights, retrieval bounds, and the decision's thresholds.

    A channel with a colon is a variant of its rule; its keys are those of the channel before it.
    """

    weights: dict[str, float] = field(default_factory=lambda: {"ex": 8.5, "bi_sort": 7.0, "acr": 6.5, "code": 6.0, "phone": 8.0, "ph_name": 5.5, "addr_st": 4.5, "post_num": 3.5, "tk": 2.0})
    bucket: int = 350
    top: int = 25
    tau: float = 0.68
    tau_single: float = 0.76
    margin: float = 0.16
    delta: float = 0.05
    adapt: tuple[float, float] = (0.08, 0.06)
    #: Claims on one target: "steal" gives it to a clear winner or nobody, "argmax" to the best claim, "plain" to every claim over tau.
    claims: str = "steal"
    #: Pairs that are hopeless whatever their score: "none", "strict" (unlike names), "region" (by country).
    gate: str = "none"
    sibling: Sibling | None = Sibling("closure", None, 0.40, 0.03)
    #: Names and addresses: "universal", or "india" (ASCII words).
    names: str = "universal"
    #: Words of names that say nothing, beyond the fixed ones; whether a country's frequent address words are left out.
    extra_suffixes: tuple[str, ...] = ()
    stops: bool = True
    #: Whether a key weighs less the more targets have it.
    damped: bool = True


V30 = Profile()
V20 = replace(V30, weights={"ex": 6.0, "bi": 5.0, "comp": 4.0, "tk": 1.0, "addr_num_st": 4.0, "addr_num_st2": 2.0, "addr_co": 4.0, "code": 5.0, "post_num": 3.0}, bucket=200, top=15, tau=0.70, tau_single=0.75, margin=0.15, adapt=(0.0, 0.0), claims="argmax", sibling=None, stops=False, damped=False)
V21 = replace(V30, weights={"ex": 7.0, "bi": 5.5, "comp": 4.5, "tk": 1.5, "addr_st": 4.0, "addr_co": 4.5, "code": 5.5, "post_num": 3.5, "phone": 8.0}, top=18, adapt=(0.0, 0.0), sibling=Sibling("loose", 0.88, 0.50, 0.02), stops=False)
V22 = replace(V30, weights={"ex": 8.0, "bi_sort": 6.5, "tk": 1.5, "addr_st": 4.5, "code": 6.0, "post_num": 3.5, "phone": 8.0}, top=18, tau=0.70, delta=0.06, adapt=(0.0, 0.0), gate="strict", sibling=Sibling("name", 0.88, 0.50, 0.02))
V23 = replace(V30, weights={"ex": 3.5, "bi_sort": 3.0, "comp:sorted": 2.5, "trunc": 2.8, "acr:plain": 3.2, "tk:all": 1.2, "addr_st:pair": 2.4, "code": 3.0, "post_num": 2.0, "phone": 3.2}, tau=0.71, tau_single=0.75, margin=0.17, gate="region", sibling=Sibling("acronym", 0.86, 0.50, 0.02))
INDIA = replace(V30, weights={"ex": 5.0, "bi": 4.0, "np": 3.0, "pp": 2.0, "tk:two": 1.0}, bucket=250, top=15, tau=0.65, adapt=(0.0, 0.0), claims="plain", sibling=None, names="india", stops=False, damped=False)
PROFILES = {"v20": V20, "v21": V21, "v22": V22, "v23": V23, "india": INDIA, "v30": V30}
