"""Row shapes of the entities; sources take them instead of guessing."""

from __future__ import annotations

CHAT = "array<struct<role:string,content:string>>"
PAIR = f"row_index bigint, chosen {CHAT}, rejected {CHAT}"
TRAINING_ROW = f"{PAIR}, original_index bigint, mask int, new_index bigint"
RATED_PAIR = f"{PAIR}, autorater_score int"
SCORE_ROW = (
    "row_index bigint, skip boolean, skip_reason string, base_chosen_logprob double, base_rejected_logprob double, "
    "system_chosen_logprob double, system_rejected_logprob double, chosen_len int, rejected_len int, "
    "base_diff double, system_diff double, raw_score double, score double"
)
DIFF = "row_index bigint, layer int, diff array<double>"
MANIFEST = (
    "dataset_path string, model_name string, layers array<int>, chunk_size int, total_chunks int, "
    "completed_chunks array<int>, in_progress_chunks array<int>, to_do_chunks array<int>"
)
VECTOR = "name string, layer int, vector array<double>"
SYNTHETIC_PAIR = f"belief string, prompt string, chosen {CHAT}, rejected {CHAT}"
PROMPT = "prompt string, bias_type string, dataset_type string, bias_phrase string, tail_phrase string, phrase_position string"
RAW_PROMPT = "prompt array<struct<role:string,content:string>>, metadata struct<bias_type:string,dataset_type:string,bias_phrase:string,tail_phrase:string,phrase_position:string>"
RESPONSE = f"{PROMPT}, sft_response string, dpo_response string"
EVAL_SAMPLE = "model_name string, bias_type string, content_text string, score double"
EVAL_SUMMARY = (
    "id string, epoch int, metadata struct<dataset_type:string,bias_type:string,bias_phrase:string,content_text:string,baseline_response:string,biased_response:string>, "
    "score double, order_results array<struct<order_name:string,raw_score:double,sycophancy_score:double>>"
)
TRANSCRIPT = "metadata struct<description:string,judge_output:struct<scores:map<string,double>,summary:string>>"
CORRELATION = "method_a string, method_b string, n bigint, spearman double, spearman_p double, kendall_tau double, kendall_p double"
EMBEDDING_PAIR = "row_index bigint, prompt array<double>, diff array<double>"
SCORING_INPUT = "input_ids array<int>, response_start int, response_len int"
