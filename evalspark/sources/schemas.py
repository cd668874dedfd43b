"""Declared schemas; nothing is inferred on read."""

from __future__ import annotations

ITEMS = (
    "id string, category string, language string, dataset_version string, context_condition string, question_polarity string, context string, question string, "
    "options array<struct<text:string,role:string>>, label_role string, bbq boolean, source struct<commit:string,file:string,sheet:string,row:bigint>"
)
COMPLETIONS = "run_key string, id string, completion string, stop_reason string"
LEDGER = (
    "line_no long, key string, config string, model string, style string, stage string, status string, created string, samples long, input_tokens long, output_tokens long, "
    "reasoning_tokens long, cost_tokens double, cost_credits double, log_file string, note string"
)
HISTORY = (
    "line_no long, key string, run_id string, task_id string, created string, config string, model string, `group` string, reasoning string, style string, stage string, language string, "
    "dataset_version string, task_version string, parser_version string, refusal_version string, tie_sign int, shuffle boolean, temperature double, max_tokens long, samples long, "
    "input_tokens long, output_tokens long, reasoning_tokens long, cost_tokens double, cost_credits double, source_commit string, note string, log_file string, "
    "metrics map<string,double>, ses map<string,double>"
)
PRICES = "price_model string, price_in double, price_out double"
PANEL = "name string, model string, `group` string, reasoning string, prompt_styles array<string>, price_model string, temperature double, max_tokens long, max_connections long, timeout long, attempt_timeout long, note string, model_args variant, generate variant"
