from trendscope.streaming.ingest import clean_stream, start_ingest

__all__ = ["clean_stream", "start_ingest"]
