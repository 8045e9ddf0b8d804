"""Explicit schemas of every table the readers and streams produce."""

from __future__ import annotations

BARS = ("symbol STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
        "volume DOUBLE, wap DOUBLE")
BAR_FIELDS = ["open", "high", "low", "close", "volume", "wap"]

KLINE = ("time_key TIMESTAMP_NTZ, code STRING, open DOUBLE, close DOUBLE, high DOUBLE, low DOUBLE, "
         "volume DOUBLE, turnover DOUBLE")
PAIR_COINT = ("pair STRING, p_14 DOUBLE, p_28 DOUBLE, p_42 DOUBLE, p DOUBLE, pmin DOUBLE, "
              "start_of_pmin TIMESTAMP_NTZ, ext STRING")
PAIR_OLS = "pair STRING, s DOUBLE, i DOUBLE, m DOUBLE, st DOUBLE, halflife DOUBLE, HE DOUBLE"
PAIR_JS = ("pair STRING, s_0 DOUBLE, s_dayslr DOUBLE, s_daysfast DOUBLE, s_hllr DOUBLE, s_hlfast DOUBLE, "
           "std_rate DOUBLE, coint_days INT, interval_secs DOUBLE, he_0 DOUBLE, hl_bars_0 DOUBLE, "
           "start BIGINT, end BIGINT, pxy DOUBLE, pyx DOUBLE, mean0 DOUBLE, std0 DOUBLE")
INSIDERS = ("ticker STRING, owner STRING, Relationship STRING, cost DOUBLE, value BIGINT, dt TIMESTAMP_NTZ, "
            "dt_sec TIMESTAMP_NTZ, markPrice DOUBLE, close DOUBLE, T STRING, `% markPrice_cost` DOUBLE, "
            "`% close_cost` DOUBLE")
SCREENER = "Symbol STRING, `Last Sale` STRING, Volume BIGINT, `Market Cap` DOUBLE"
PLATES = ("plateCodeToCnName MAP<STRING,STRING>, stocks MAP<STRING, STRUCT<code: STRING, stock_name: STRING, "
          "list_time: STRING, plates: MAP<STRING,DOUBLE>>>")

# The four pushed feeds.
FEED_TICKER = ("code STRING, time TIMESTAMP, price DOUBLE, volume DOUBLE, turnover DOUBLE, "
               "ticker_direction STRING, sequence BIGINT, type STRING, push_data_type STRING")
FEED_QUOTE = ("code STRING, data_date STRING, data_time STRING, last_price DOUBLE, open_price DOUBLE, "
              "high_price DOUBLE, low_price DOUBLE, prev_close_price DOUBLE, volume DOUBLE, turnover DOUBLE, "
              "turnover_rate DOUBLE, amplitude DOUBLE, suspension BOOLEAN, listing_date STRING, "
              "price_spread DOUBLE, sec_status STRING")
FEED_INTRADAY = ("code STRING, time TIMESTAMP, is_blank BOOLEAN, opened_mins INT, cur_price DOUBLE, "
                 "last_close DOUBLE, avg_price DOUBLE, turnover DOUBLE, volume DOUBLE")
FEED_KLINE = ("code STRING, time_key TIMESTAMP, open DOUBLE, close DOUBLE, high DOUBLE, low DOUBLE, "
              "volume DOUBLE, turnover DOUBLE, k_type STRING, last_close DOUBLE")
FEEDS = {"ticker": FEED_TICKER, "quote": FEED_QUOTE, "intraday": FEED_INTRADAY, "kline": FEED_KLINE}
