"""Messages for tests."""

import json
from datetime import datetime

from telemill import schemas

TIME = "2024-01-05T14:35:22Z"
ARRIVED = datetime(2024, 1, 5, 14, 35, 23)


def message(type_name, metrics=None, device="dev-1", time=TIME, **extra) -> str:
    body = {"device_id": device, "type": type_name, "timestamp": time, **extra}
    if metrics is not None:
        body["metrics"] = metrics
    return json.dumps({k: v for k, v in body.items() if v is not None})


def energy(power=120.5, energy_wh=500.0, voltage=220.0, current=455.0) -> str:
    return message(
        "energy_meter",
        {"power_w": power, "energy_wh": energy_wh, "voltage_v": voltage, "current_ma": current},
    )


def finance(amount=1599, currency="USD", merchant="Amazon", status="completed") -> str:
    return message(
        "financial_stream",
        {"amount_minor": amount, "currency": currency, "merchant": merchant, "status": status},
    )


def climate(temperature=22.8, humidity=55.2, aqi=34, type_name="temperature_sensor") -> str:
    return message(
        type_name, {"temperature_c": temperature, "humidity_percent": humidity, "air_quality_index": aqi}
    )


def records(spark, values, topic="t", arrived=ARRIVED, start=0):
    """Texts as Kafka-shaped records, in order."""
    rows = [(topic, 0, start + i, arrived, None, v, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, schemas.MESSAGES)
