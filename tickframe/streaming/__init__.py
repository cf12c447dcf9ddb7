from tickframe.streaming.bars import late_rows, stream_daily_bars, write_bar_stream

__all__ = ["late_rows", "stream_daily_bars", "write_bar_stream"]
