"""Keyed state: the exact limiter and the repetition log, for streams and for replays."""
