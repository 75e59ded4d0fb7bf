"""Flow operators over event time, on tables and as streaming queries with watermarks and state."""

from graphloom.streaming.flows import aligned_windows, anchored_windows, count_or_time_batches, debounce, sampled, sessions, throttle, throttle_stream, upsert_stream
