"""Plain configuration objects. They are read on the driver while Columns are being built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

# Plain-text spellings of physics symbols that should have been LaTeX.
PHYSICS_PLAIN_TEXT_PATTERNS = (
    r"\bsigma_[xyz]\b",
    r"\bpsi\b(?![_^\\])",
    r"\bH\s*=\s*[^$\\]",
    r"\bhbar\b(?!\\)",
)

# Topic keywords counted for quantum-physics datasets.
QUANTUM_TOPICS = (
    "qubit", "entangle", "hamiltonian", "eigenvalue", "spin",
    "operator", "wave", "quantum", "state", "circuit", "gate",
    "measurement", "superposition", "decoherence", "density",
)


@dataclass(frozen=True)
class DomainCheck:
    """A named, case-insensitive regular expression looked for in an output."""

    name: str
    pattern: str


@dataclass(frozen=True)
class IssueTexts:
    """Wording of the rule messages that differ between the general and the physics profile."""

    plain_text: str = "Plain text found (should be LaTeX): "
    no_latex: str = "No LaTeX math detected - response should contain LaTeX"
    short_answer: str = "Answer too short - may be incomplete"
    loop: str = "Possible reasoning loop - repetitive sentence structures"


PHYSICS_TEXTS = IssueTexts(
    plain_text="Plain text physics found (should be LaTeX): ",
    no_latex="No LaTeX math detected - physics response should contain LaTeX",
    short_answer="Answer too short",
    loop="Possible reasoning loop",
)


@dataclass(frozen=True)
class Rules:
    """Validation rules of a task. ``None`` lengths mean "the operator's own default"."""

    require_tags: tuple[tuple[str, str], ...] = ()
    require_latex: bool = False
    min_reasoning_length: int | None = None
    min_answer_length: int | None = None
    check_latex_consistency: bool = True
    plain_text_patterns: tuple[str, ...] = ()
    domain_checks: tuple[DomainCheck, ...] = ()
    min_domain_score: int = 0
    topics: tuple[str, ...] = ()
    texts: IssueTexts = IssueTexts()

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None) -> Rules:
        """Build from the ``validation`` section of a task file already parsed into a mapping."""
        raw = dict(raw or {})
        known = {}
        if "require_tags" in raw:
            known["require_tags"] = tuple((a, b) for a, b in raw["require_tags"])
        if "domain_checks" in raw:
            known["domain_checks"] = tuple(
                DomainCheck(c["name"], c["pattern"]) for c in raw["domain_checks"]
            )
        for name in ("plain_text_patterns", "topics"):
            if raw.get(name):
                known[name] = tuple(raw[name])
        for name in (
            "require_latex", "min_reasoning_length", "min_answer_length",
            "check_latex_consistency", "min_domain_score",
        ):
            if name in raw:
                known[name] = raw[name]
        return cls(**known)

    @classmethod
    def physics(cls) -> Rules:
        """The physics profile: plain-text symbol checks on, its own message wording."""
        return cls(plain_text_patterns=PHYSICS_PLAIN_TEXT_PATTERNS, texts=PHYSICS_TEXTS)


@dataclass(frozen=True)
class Task:
    """Prompts and rules of a generation task."""

    system_prompt: str
    user_template: str
    rules: Rules = Rules()
    max_retries: int = 3

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> Task:
        generation = raw["generation"]
        return cls(
            system_prompt=generation["system_prompt"],
            user_template=generation["user_prompt_template"],
            rules=Rules.from_mapping(raw.get("validation")),
            max_retries=int(generation.get("max_retries", 3)),
        )

    def with_system_prompt(self, prompt: str | None) -> Task:
        return replace(self, system_prompt=prompt) if prompt else self


@dataclass(frozen=True)
class SplitRatios:
    """Train / validation / test shares; ``seed`` picks one of the deterministic orders."""

    train: float = 0.6
    val: float = 0.2
    test: float = 0.2
    seed: int = 3407


# Used when a training set comes without its own split section.
SIMPLE_SPLIT = SplitRatios(train=0.8, val=0.1, test=0.1)


@dataclass(frozen=True)
class SftConfig:
    """How source columns become one training text."""

    prompt_template: str
    instruction: str = "instruction"
    response: str = "response"
    context_fields: tuple[str, ...] = ()
    context_format: str | None = None
    options: tuple[str, ...] = ()
    correct_option: str | None = None
    split: SplitRatios | None = None
    domain: str = "General"

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> SftConfig:
        fields = raw.get("fields", {})
        split = raw.get("train_val_test_split")
        return cls(
            prompt_template=raw.get("prompt_template", ""),
            instruction=fields.get("instruction", "instruction"),
            response=fields.get("response", "response"),
            context_fields=tuple(fields.get("context_fields", ())),
            context_format=raw.get("context_format"),
            options=tuple(fields.get("options", ())),
            correct_option=fields.get("correct_option"),
            split=SplitRatios(**split) if split else None,
            domain=raw.get("domain", raw.get("name", "General")),
        )


@dataclass(frozen=True)
class FieldMapping:
    """Source columns that become ``question`` and ``answer``, and columns carried along."""

    question: str
    answer: str
    metadata: tuple[str, ...] = field(default_factory=tuple)
