"""quantjobs.plans"""
