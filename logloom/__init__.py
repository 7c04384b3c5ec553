"""Log analytics on Spark: read, detect, stitch, parse, enrich, report."""

from .functions.enrichment import (
    line_type as detect_line_type,
    redact_pii,
    response_time_ms as parse_response_time,
    user_agent as parse_user_agent,
)
from .functions.sql import register_sql_functions
from .operators.assemble import assemble_records, records_of
from .operators.clusters import ClusterModel, cluster_errors, cluster_sizes, fit_clusters, label_errors
from .operators.detect import detect_format, detect_formats, with_format
from .operators.distributions import (
    activity_heatmap,
    error_heatmap,
    hourly_volume,
    http_stats,
    level_counts,
    level_timeline,
    line_type_counts,
    method_counts,
    response_series,
    status_counts,
    worker_summary,
)
from .operators.enrich import add_enrichments
from .operators.filters import apply_filters, distinct_values, filter_keyword, filter_time, filter_values
from .operators.hourly import anomaly_summary, hourly_counts, hourly_metrics, spikes
from .operators.modules import errors_per_module, module_ranking, module_type_pivot, top_error_rates
from .operators.ordering import max_lines, page_rows
from .operators.parse import (
    from_rows,
    get_all_format_info,
    get_format_info,
    get_supported_formats,
    parse,
    register_parser,
    unregister_parser,
)
from .operators.phrases import top_error_phrases, top_phrases
from .operators.redact import add_redacted, redact_columns
from .operators.sequences import error_history, mine_sequences, sequence_text
from .plans.pipeline import load_logs, logs_from_lines
from .schema import ENRICHED_SCHEMA, LINE_SCHEMA, LOG_SCHEMA
from .sources.lines import lines_of_table, read_lines, read_windows_events, stream_lines
from .sources.sinks import write_csv, write_json, write_parquet
from .streaming.jobs import stream_hourly, stream_logs
