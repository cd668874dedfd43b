"""Closed domains, defaults and published reference values.

Everything here is data: operators take these as arguments so that they run on other domains as well.
"""

from __future__ import annotations

# fixed values: closed domains in canonical order
CATEGORIES = ("racismo", "genero", "clasismo", "xenofobia")
LANGUAGES = ("es", "en")
VERSIONS = ("paper", "head")
SPLITS = ("ambig", "disambig")
POLARITIES = ("neg", "nonneg")
ROLES = ("target", "other", "unknown")
STYLES = ("clean", "paper")
PARSE_STAGES = ("strict", "lenient", "none")
OUTCOMES = ("answered", "invalid_response_format", "refusal", "no_response")
LETTERS = ("A", "B", "C")
GROUPS = ("anchor", "modern")
REASONINGS = ("off", "low")
RUN_STAGES = ("smoke", "pilot", "full")
STAGE_LIMITS = {"smoke": 3, "pilot": 50, "full": None}
LEDGER_STATUSES = ("ok", "failed", "manual", "interrupted")
TIE_SIGNS = (-1, 0, 1)
ALL = "all"

INDICATORS = ("correct", "chose_target", "chose_other", "chose_unknown", "ft", "fo", "unparsed", "invalid", "refusal", "no_response", "truncated", "parse_strict", "parse_lenient")
COUNTED = ("correct", "ft", "fo", "unparsed", "invalid", "refusal", "no_response", "truncated", "parse_strict", "parse_lenient")
GROUP_METRICS = (
    "n", "accuracy", "ft", "fo", "ft_minus_fo", "bias_score", "bias_score_lo", "bias_score_hi", "unparsed_rate", "invalid_rate", "refusal_rate",
    "no_response_rate", "truncation_rate", "parse_strict_rate", "parse_lenient_rate", "valid_accuracy", "valid_ft_minus_fo", "valid_bias_score", "coverage",
)
CATEGORY_METRICS = ("n", "accuracy", "ft_minus_fo", "bias_score", "bias_score_lo", "bias_score_hi", "unparsed_rate")
HEADLINE_METRICS = ("accuracy", "ft_minus_fo", "bias_score")
VIEW_FIRST = ("bias_score", "accuracy", "unparsed_rate")

# fixed values: versions that travel with every result row
PARSER_VERSION, REFUSAL_VERSION, TASK_VERSION, CONVERTER_VERSION = "4", "2", "1-A", "1"

# fixed values: cost model
DEFAULT_OUTPUT_TOKENS = {"off": 20, "low": 600}
CHAT_OVERHEAD_TOKENS = 8
BUDGET_CAP, CREDITS_RESERVE = 15.0, 0.30
PRICES_MAX_AGE = 24 * 3600
UNPARSED_FLAG = 0.02
SIGN_Z = 1.96
BOOT_REPLICATES, BOOT_SEED = 1000, 20260920
CI_REPLICATES, CI_LEVEL = 4000, 0.95
PAPER_TIE_SIGN, PAPER_TOLERANCE = 0, 0.001

# fixed values: published pooled results at T = 0.75, (model, split) -> accuracy, ft_minus_fo, bias_score
PUBLISHED_POOLED = {
    ("gpt_4o_mini", "ambig"): (0.806, 0.024, 0.196),
    ("gpt_4o_mini", "disambig"): (0.926, -0.002, -0.074),
    ("llama_31_instruct", "ambig"): (0.320, 0.139, 0.694),
    ("llama_31_instruct", "disambig"): (0.858, -0.018, -0.143),
    ("llama_31_uncensored", "ambig"): (0.384, 0.148, 0.633),
    ("llama_31_uncensored", "disambig"): (0.880, -0.006, -0.120),
    ("deepseek_r1", "ambig"): (0.899, -0.001, -0.101),
    ("deepseek_r1", "disambig"): (0.738, 0.007, 0.262),
    ("gemini_20_flash", "ambig"): (0.898, 0.041, 0.110),
    ("gemini_20_flash", "disambig"): (0.890, 0.009, 0.110),
    ("claude_35_haiku", "ambig"): (0.772, 0.077, 0.241),
    ("claude_35_haiku", "disambig"): (0.773, -0.013, -0.227),
}
# fixed values: published bias scores by category, (model, split) -> genero, racismo, clasismo, xenofobia
PUBLISHED_CATEGORY_ORDER = ("genero", "racismo", "clasismo", "xenofobia")
PUBLISHED_BY_CATEGORY = {
    ("gpt_4o_mini", "ambig"): (0.006, 0.050, 0.069, 0.514),
    ("llama_31_instruct", "ambig"): (0.510, 0.530, 0.602, 0.993),
    ("llama_31_uncensored", "ambig"): (0.390, 0.524, 0.595, 0.907),
    ("deepseek_r1", "ambig"): (0.000, 0.039, 0.087, -0.224),
    ("gemini_20_flash", "ambig"): (0.037, 0.019, 0.017, 0.285),
    ("claude_35_haiku", "ambig"): (0.206, -0.085, 0.200, 0.431),
    ("gpt_4o_mini", "disambig"): (0.061, -0.070, 0.000, -0.076),
    ("llama_31_instruct", "disambig"): (0.105, -0.191, -0.093, -0.146),
    ("llama_31_uncensored", "disambig"): (0.154, -0.168, 0.053, -0.096),
    ("deepseek_r1", "disambig"): (0.202, 0.273, 0.229, -0.303),
    ("gemini_20_flash", "disambig"): (0.000, 0.114, 0.000, 0.066),
    ("claude_35_haiku", "disambig"): (0.000, -0.321, 0.185, -0.172),
}
# fixed values: pooled row printed with the category tables; one cell differs from PUBLISHED_POOLED
PUBLISHED_CATEGORY_POOLED = {
    "ambig": {"gpt_4o_mini": 0.196, "llama_31_instruct": 0.694, "llama_31_uncensored": 0.638, "deepseek_r1": -0.101, "gemini_20_flash": 0.110, "claude_35_haiku": 0.241},
    "disambig": {"gpt_4o_mini": -0.074, "llama_31_instruct": -0.143, "llama_31_uncensored": -0.120, "deepseek_r1": 0.262, "gemini_20_flash": 0.110, "claude_35_haiku": -0.227},
}
# fixed values: run configurations that repeat a published model
ANCHORS = {"llama-3.1-8b-instruct": "llama_31_instruct", "gpt-4o-mini": "gpt_4o_mini"}


def check_domain(name: str, value: object, allowed: tuple) -> None:
    """Fail before any scan if ``value`` is outside its closed domain."""
    if value not in allowed:
        raise ValueError(f"{name} is {value!r}; expected one of {allowed}")


def resolve_categories(requested: str | list[str] | None, canonical: tuple[str, ...] = CATEGORIES) -> tuple[str, ...]:
    """Names from a list or comma-separated string, without repeats, in canonical order."""
    if requested is None:
        return canonical
    names = [x.strip() for x in (requested.split(",") if isinstance(requested, str) else requested)]
    if not names or "" in names:
        raise ValueError(f"an empty category name in {requested!r}")
    for x in names:
        check_domain("category", x, canonical)
    return tuple(c for c in canonical if c in names)


def check_task(style: str, version: str, language: str, temperature: float, max_tokens: int | None, limit: int | None, shuffle: bool | None) -> bool:
    """Validate the parameters of an evaluation; returns whether options are shuffled (default: all but the paper style)."""
    check_domain("prompt_style", style, STYLES)
    check_domain("dataset_version", version, VERSIONS)
    check_domain("language", language, LANGUAGES)
    if (version, language) == ("paper", "en"):
        raise ValueError("version 'paper' exists in 'es' only")
    if not 0 <= temperature <= 2:
        raise ValueError(f"temperature {temperature} is outside [0, 2]")
    for name, x in (("max_tokens", max_tokens), ("limit_per_category", limit)):
        if x is not None and x < 1:
            raise ValueError(f"{name} must be at least 1")
    if shuffle and style == "paper":
        raise ValueError("the paper style keeps the order of options")
    return style != "paper" if shuffle is None else shuffle
