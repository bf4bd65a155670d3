"""Choice of provider, model and method of a stage."""

from __future__ import annotations

from dataclasses import dataclass

# Providers with their default models, and the methods by name.
MODELS = {
    "openai": "gpt-5.1",
    "ollama": "llama3.2",
}
METHODS = (
    "pipeline",
    "zero-shot-llm",
    "few-shot-llm",
    "rule-based",
    "quantulum3",
)


@dataclass(frozen=True)
class Stage:
    provider: str
    model: str

    @property
    def local(self) -> bool:
        return self.provider == "ollama"


def stage(provider: str | None = "openai", model: str | None = None) -> Stage:
    """Names are read without case and blanks; an empty model is the provider's default."""
    name = (provider or "openai").strip().lower()
    if name not in MODELS:
        raise ValueError(f"unknown provider {provider!r}: one of {', '.join(MODELS)}")
    return Stage(name, (model or "").strip() or MODELS[name])


def method(name: str | None = None, default: str = "pipeline") -> str:
    found = (name or default).strip().lower().replace("_", "-")
    if found not in METHODS:
        raise ValueError(f"unknown method {name!r}: one of {', '.join(METHODS)}")
    return found


def prompt_style(name: str) -> str:
    return "zero_shot" if name == "zero-shot-llm" else "few_shot"
