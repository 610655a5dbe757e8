Table	Create Table
shop_json	CREATE TABLE "shop_json" (\n  "id" int NOT NULL,\n  "payload" json DEFAULT NULL,\n  "blob_data" longblob,\n  PRIMARY KEY ("id"),\n  CONSTRAINT "chk" CHECK (json_valid("payload"))\n)
