"""One-line description of every registered query (``python -m parley list``)."""

DESCRIPTIONS = {
    "active_models": "active model versions with config fields parsed from JSON",
    "active_users": "active users (key lookup by id / email optional)",
    "alert_error_rate": "5-min sliding error rate over threshold, held for 2 min",
    "alert_latency": "5-min sliding p95 latency from histogram buckets over threshold, held 5 min",
    "apply_titles": "conversation table rewritten with titles from first user messages",
    "archive_conversations": "conversation table rewritten with old conversations archived",
    "archive_counts": "rows archived by the rewrite (the reference's rowcount)",
    "assemble_chunks": "finished messages assembled from SSE chunk lines",
    "best_checkpoint": "lowest-eval-loss step per training session",
    "cache_live": "cached datasets whose TTL has not expired",
    "cascade_delete": "per-table delete counts of an ON DELETE CASCADE of inactive users",
    "check_dims": "embedding dimension check",
    "check_enums": "role / feedback type in list and score in range, counts per rule",
    "check_not_null": "null counts of required message columns",
    "check_users": "email format and username length per user",
    "checkpoint_retention": "newest 5 checkpoints per session",
    "chunk_stats": "SSE lines, malformed lines and finish marker per message",
    "code_blocks": "fenced code blocks (language, body) of assistant answers",
    "conversation_context": "first n messages of every conversation",
    "conversation_documents": "conversations with their messages in time order (flat)",
    "conversation_titles": "title of every conversation from its first user message",
    "decode_requests": "request topic records decoded from JSON",
    "dequeue_tasks": "next 50 pending tasks by priority and age",
    "dispatch_tasks": "every task run through its handler: status, output JSON, error",
    "duplicate_keys": "key values that occur more than once",
    "encode_requests": "trainer tasks encoded as (topic, key, JSON value) records",
    "epoch_stats": "eval-loss count / mean / min / max per epoch",
    "eval_results": "evaluation tasks stored as eval_<task> model versions",
    "evaluate_summary": "mean reward of the first 50 evaluation rows",
    "evaluation_dataset": "top 100 (query, response) by average rating",
    "feedback_backup": "last days of ratings with the rated message text",
    "feedback_dataset": "rated answers paired with the user message before them",
    "feedback_stats": "average score and count per conversation owner and feedback type",
    "format_dates": "run-name and ISO stamps of message times",
    "format_latency": "inference latency as 1m 5s / 12s / 345ms",
    "hallucination_check": "answers longer than twice the user message",
    "history_display": "sidebar title with fallback and update date",
    "last_login": "user table rewritten with the latest login time",
    "latency_p95_exact": "exact p95 latency per 5-min sliding window (raw values)",
    "latency_sketch": "p95 per model from merged quantile sketches, within their rank error",
    "latency_by_model": "count, mean and p95 inference latency per model",
    "live_gauges": "latest gauge value per key within its TTL",
    "mean_pool": "element-wise mean embedding per label",
    "message_preview": "first 100 characters of trimmed message text",
    "normalize_feedback": "SQLite-form ratings mapped to the canonical schema",
    "orphan_feedback": "rows whose foreign key has no parent",
    "pair_text": "reward-model input text per rated pair",
    "score_pairs_reloaded": "rewards of held-out pairs by a saved and reloaded model",
    "reward_text_scores": "held-out pairs scored on their texts",
    "polled_requests": "closed request windows of a log that a stream has polled",
    "pairwise_preference": "P(a over b) of held-out queries' pairs, logistic model by Newton steps",
    "preference_from_rewards": "P(a over b) from the reward model's scores of both responses",
    "training_sample": "a tenth of the pool in sample-key order, cut by a histogram of keys",
    "parse_chunks": "SSE lines parsed into kind / content / finish reason",
    "preference_pairs": "response pairs of a query whose averages differ by > 0.2",
    "queue_depth": "waiting tasks per agent type and alarm flag",
    "rate_limit_decisions": "allow / deny and remaining quota of every request",
    "recent_feedback": "ratings of the last days",
    "regenerate_requests": "prompt to resend and history kept for each answer",
    "render_prompts": "model prompt of every conversation (digest and length)",
    "request_params": "effective temperature and token limits per request",
    "requests_per_window": "requests per user, endpoint and minute",
    "response_scores": "average score and count per (query, response)",
    "reward_model_eval": "reward regressor fitted on a disjoint split, held-out MSE",
    "reward_mse": "held-out MSE of the mean-label baseline",
    "route_requests": "decoded requests with their processing route",
    "sample_check": "reward dataset size and whether it reaches the minimum",
    "scan_messages": "message table projected and renamed",
    "score_feedback_types": "UI rating type to numeric score",
    "score_pairs": "reward of every rated pair from the fitted model",
    "semantic_topk": "exact cosine top-5 messages per label centroid",
    "semantic_topk_pruned": "exact top-k vectors, tiles skipped by the triangle inequality",
    "session_state": "training session state from its event log",
    "stale_conversations": "unarchived conversations older than the cut-off",
    "start_tasks": "task table rewritten with the dequeued tasks running",
    "stuck_tasks": "tasks running for more than an hour",
    "task_payload": "task payload fields with defaults",
    "task_state": "task table rewritten from its status event log",
    "token_usage": "prompt / completion / total whitespace tokens per conversation and model",
    "toxicity_check": "keyword toxicity flag and confidence per message",
    "train_test_split": "stable disjoint 80/20 split of the reward dataset",
    "training_batch": "reproducible sample of 8 (query, conversation) rows",
    "training_pool": "distinct user queries of rated conversations",
    "training_progress": "latest progress percent and metrics per session",
    "unanswered_conversations": "conversations whose latest message is the user's",
    "user_history": "non-archived conversations per owner",
    "new_conversations": "conversation rows with the writer's defaults",
    "new_users": "user rows with tier and activity defaults",
    "new_messages": "incoming messages without blank ones",
    "rejected_feedback": "feedback rows that a checked append keeps out",
    "new_tasks": "agent task rows with priority and status defaults",
    "new_training_sessions": "pending training session rows",
    "run_manifest": "run manifest rows with stamp and JSON",
    "cache_entries": "rows of a cached dataset with key and expiry",
    "counter_keys": "composite counter keys and stable record ids",
    "conversation_nested": "one row per conversation with its message array",
    "conversation_of_owner": "one conversation by id and owner with its messages",
    "kept_history": "messages that stay when an answer is regenerated",
    "history_list": "conversation ids per owner after new ones are put in front",
    "embedded_users": "embedded-form users in canonical columns",
    "embedded_conversations": "embedded-form conversations in canonical columns",
    "embedded_messages": "embedded-form messages in canonical columns",
    "embedded_model_versions": "embedded-form model versions in canonical columns",
}
