Table	Create Table
shop_history	CREATE TABLE "shop_history" (\n  "history_id" int NOT NULL AUTO_INCREMENT,\n  "object_id" varchar(64) DEFAULT NULL,\n  "phone_number" varchar(20) DEFAULT NULL,\n  "discount" double DEFAULT NULL,\n  "history_date" datetime(6) NOT NULL,\n  PRIMARY KEY ("history_id")\n)
