Table	Create Table
shop_order	CREATE TABLE "shop_order" (\n  "id" bigint unsigned NOT NULL AUTO_INCREMENT,\n  "user_id" int NOT NULL,\n  "total_amount" decimal(20,8) NOT NULL,\n  "fee_amount" double DEFAULT NULL,\n  "status" varchar(16) NOT NULL,\n  "updated_at" datetime(6) NOT NULL,\n  "created_at" datetime(3) NOT NULL,\n  PRIMARY KEY ("id"),\n  KEY "shop_order_user" ("user_id"),\n  CONSTRAINT "fk_user" FOREIGN KEY ("user_id") REFERENCES "shop_user" ("id")\n)
