"""The tables that the library works on."""

RECORD = (
    "source string, source_path string, name string, purpose string, prompt string, tools array<string>, data_sources array<string>, "
    "permissions array<string>, input_modes array<string>, output_modes array<string>, model string, framework string, metadata string"
)
MODULE = "module_id string, agent_id string, kind string, label string, content string, reference string"
PROBE = "id string, grp string, planted string, prompt string, hash string"
RESPONSE = "key string, run_id string, agent_id string, probe_id string, rep int, text string, usage struct<input:long,output:long,thinking:long>, stop_reason string"
JUDGMENT = "key string, text string"
RESULT = (
    "key string, agent_id string, task_id string, capability string, rep int, requested_model string, passed boolean, cost_usd double, "
    "scorer_version int, answer string"
)
#: What a judge answers yes or no to: fixed values.
JUDGE_FIELDS = ("asked_clarifying_question", "declined_or_redirected", "pushed_back", "wrote_code", "wrote_tests", "flagged_security")
#: What catching a planted issue counts: fixed values; n/a does not count.
CAUGHT = {"yes": 1.0, "partly": 0.5, "no": 0.0}
