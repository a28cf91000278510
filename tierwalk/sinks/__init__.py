from tierwalk.sinks.answers import write_answers, write_run_metrics

__all__ = ["write_answers", "write_run_metrics"]
