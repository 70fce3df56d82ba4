from datetime import date, timedelta

from tidewatch import schema


def day(text: str) -> date:
    return date.fromisoformat(text)


def track(spark, streams, artist="A", title="T", start="2020-01-01", region="Global"):
    first = day(start)
    rows = [(title, first + timedelta(days=i), artist, region, None if v is None else float(v))
            for i, v in enumerate(streams)]
    return spark.createDataFrame(rows, schema.CHARTS)


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
