"""lakeweave.plans"""
