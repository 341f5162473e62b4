"""Schemas of the tables that the operators take and give, as DDL."""

PARALLEL = "source string, target string, origin string, row_number long, domain string, metadata string"
REJECTED = "source string, target string, origin string, row_number long, reasons array<string>, detail string"
REPORT = (
    "total_rows long, accepted_rows long, rejected_rows long, duplicate_rows long, empty_rows long, missing_value_rows long, length_failures long, length_ratio_failures long, "
    "language_mismatch_rows long, malformed_markup_rows long, conflicting_pairs long, exact_source_duplicates long, exact_target_duplicates long, input_files array<string>"
)
ENCODED = "source_ids array<int>, target_ids array<int>, source string, target string, domain string"
GENERATION = "output_ids array<int>, score double, confidence double"
EVENT = (
    "timestamp string, event string, epoch int, step int, training_loss double, learning_rate double, gradient_norm double, tokens_processed long, examples_processed long, "
    "elapsed_seconds double, estimated_progress double, device_memory map<string,double>, path string, loss double, bleu double, chrf double"
)
VERSION = (
    "version_id string, version_label string, parent_version string, status string, protected boolean, created_at string, language_pair string, direction string, "
    "tokenizer_version string, dataset_versions array<string>, metrics map<string,double>, config string"
)
POINTER = "production_version string"
PREDICTION = "row_id long, source string, reference string, candidate string"
TERMS = "term string, forms array<string>"
